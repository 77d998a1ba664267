"""From a query's data to one DataFrame: scopes, joins, where, aggregates, order, limit, select."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import HiddenField, InvalidArgument, InvalidQuery, TenantRequired
from ..functions.expressions import Agg, Name, Raw, fold
from ..operators import relations

if TYPE_CHECKING:
    from ..operators.query import Query


def resolver(query: Query):
    """Names to columns; a model's field names become its column names."""
    model, alias = query.model, query.name

    def resolve(name: str) -> Column:
        if "." in name or model is None or query.spec.joins or query.spec.aggs or query.spec.group:
            if model is not None and name in model.fields:
                return F.col(f"{alias}.{model.fields[name].column}")
            return F.col(name)
        return F.col(f"{alias}.{model.column(name)}")

    return resolve


def scoped(query: Query) -> DataFrame:
    """The source with its own scopes: shard, tenant, soft deletion."""
    df, model, engine = query.source(), query.model, query.engine
    if model is not None:
        if model.tenant:
            values = engine.tenant_values()
            for name in model.tenant:
                if name not in values:
                    raise TenantRequired(f"{model.table} needs {name}")
                df = df.where(F.col(model.column(name)) == F.lit(values[name]))
        if model.shard is not None and not query.spec.all_shards:
            shard = query.spec.shard if query.spec.shard is not None else engine.asked("shard_values").get(model.shard.column)
            df = model.shard.only(df, shard) if shard is not None else df
        if model.deleted and query.spec.deleted != "with":
            mark = F.col(model.deleted)
            df = df.where(mark.isNull() if query.spec.deleted == "without" else mark.isNotNull())
    return df.alias(query.name)


def lower(query: Query) -> DataFrame:
    for plugin in query.spec.plugins:  # plugins may change the query
        query = plugin.on_query(query) if hasattr(plugin, "on_query") else query
    for extension in query.engine.extensions.values():
        query = extension.on_query(query.engine, query) if hasattr(extension, "on_query") else query
    spec, resolve = query.spec, resolver(query)
    df = scoped(query)
    for j in spec.joins:
        right = _right(query, j)
        cond = fold(list(j.on))
        if j.kind == "cross":
            df = df.crossJoin(right)
        elif cond is None:
            raise InvalidArgument(f"the {j.kind} join has no condition")
        elif j.kind == "full":
            df = _full(df, right, cond.build(F.col))
        else:
            df = df.join(right, cond.build(F.col), j.kind)
    parts = [("and" if i == 0 else joiner, c) for i, (joiner, c) in enumerate(spec.where)]
    cond = fold(parts)
    if cond is not None:
        df, cond = relations.prepare(query, df, parts, cond)
        if cond is not None:
            df = df.where(cond.build(resolve))
    df, names = relations.with_aggregates(query, df)
    df = _grouped(query, df, resolve) if spec.group or _aggregates(spec) else _plain(query, df, resolve, names)
    return df


def _full(df: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    """A left join and the right rows without a partner: Spark's full join holds all pairs of a key in memory at once."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.join(right.hint("merge"), cond, "left").union(right.join(df, cond, "left_anti").select(*none, "*"))


def _right(query: Query, j: Any) -> DataFrame:
    source = j.source
    if isinstance(source, str):
        table, _, alias = source.partition(" ")
        return scoped(query.engine.table(table).as_(j.alias or alias or table))
    df = source if isinstance(source, DataFrame) else source.df()
    if not j.alias:
        raise InvalidArgument("a joined query needs an alias")
    return df.alias(j.alias)


def _aggregates(spec: Any) -> bool:
    return any(isinstance(x, Agg) for x in spec.select)


def _item(x: Any, resolve: Any) -> Column:
    if isinstance(x, str):
        return resolve(x)
    if isinstance(x, Column):
        return x
    if isinstance(x, Name):
        return x.build(resolve).alias(x.alias or x.name.rpartition(".")[2])
    if isinstance(x, Raw):
        return x.build(resolve).alias(x.name) if x.name else x.build(resolve)
    if hasattr(x, "label"):
        return x.build(resolve).alias(x.label)
    if isinstance(x, tuple) and len(x) == 2:  # (query, alias): a scalar subquery
        return x[0].scalar_column().alias(x[1])
    raise InvalidArgument(f"can't select {x!r}")


def _ordered(df: DataFrame, order: tuple, resolve: Any) -> DataFrame:
    """NULLs come first ascending and last descending."""
    if not order:
        return df
    keys = [(resolve(x) if isinstance(x, str) else x.build(resolve) if hasattr(x, "build") else x, desc) for x, desc in order]
    return df.orderBy(*[k.desc_nulls_last() if desc else k.asc_nulls_first() for k, desc in keys])


def _cut(df: DataFrame, spec: Any) -> DataFrame:
    if spec.offset:
        df = df.offset(spec.offset)
    if spec.limit is not None:
        df = df.limit(spec.limit)
    return df


def _plain(query: Query, df: DataFrame, resolve: Any, names: list[str]) -> DataFrame:
    spec, model = query.spec, query.model
    if spec.having:
        raise InvalidQuery("HAVING needs GROUP BY or an aggregate")
    hidden = model.hidden_columns if model else set()
    opened = {model.column(h) for h in spec.hidden} if model else set()
    for h in opened - hidden:
        raise InvalidArgument(f"{h} isn't hidden")
    df = _ordered(df, spec.order, resolve)
    df = _cut(df, spec)
    if spec.select:
        for x in spec.select:
            name = x if isinstance(x, str) else getattr(x, "name", None) if isinstance(x, Name) else None
            if name and model and "." not in name and not spec.joins and model.column(name) in hidden - opened:
                raise HiddenField(name)
        columns = [_item(x, resolve) for x in spec.select]
    elif model:
        have = set(df.columns)
        columns = [F.col(f"{query.name}.{c}") for c in model.default_columns if c in have]
        columns += [F.col(f.column) for f in model.fields.values() if f.virtual and f.column in have and f.column not in names]
    else:
        columns = [F.col(f"{query.name}.*")] if spec.joins or names else []
    columns += [F.col(f"{query.name}.{c}") for c in sorted(opened)] + [F.col(n) for n in names]
    if spec.loads:
        columns = columns or [F.col(f"{query.name}.*")]
        return relations.with_loads(query, df, columns)
    return df.select(*columns) if columns else df


def _grouped(query: Query, df: DataFrame, resolve: Any) -> DataFrame:
    spec = query.spec
    keys = [resolve(g).alias(g.rpartition(".")[2]) for g in spec.group]
    key_names = [g.rpartition(".")[2] for g in spec.group]
    aggs, out = [], []
    for x in spec.select:
        if isinstance(x, Agg) or isinstance(x, Raw):
            label = x.label if isinstance(x, Agg) else x.name
            aggs.append(x.build(resolve).alias(label))
            out.append(label)
        else:
            name = x if isinstance(x, str) else x.name
            out.append((name.rpartition(".")[2], getattr(x, "alias", None)))
    tests = []
    for i, h in enumerate(spec.having):
        kind, args = h
        if kind == "raw":
            aggs.append(args.build(resolve).alias(f"__having{i}"))
            tests.append(F.col(f"__having{i}"))
            continue
        names = {}
        for a in args[1]:
            if isinstance(a, Agg):
                names[a] = f"__having{i}_{len(names)}"
                aggs.append(a.build(resolve).alias(names[a]))
        tests.append(args[0]({a: F.col(n) for a, n in names.items()}))
    df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    for t in tests:
        df = df.where(t)
    plain = lambda n: F.col(n.rpartition(".")[2])
    df = _cut(_ordered(df, spec.order, plain), spec)
    columns = [F.col(o) if isinstance(o, str) else F.col(o[0]).alias(o[1] or o[0]) for o in out]
    return df.select(*(columns or [F.col(k) for k in key_names]))
