"""Relations as joins: filters (semi, anti, count), aggregates, eager loads and scoping by an instance.

A filter that stands alone in an AND is a semi or anti join; under OR or NOT,
and with a count, the children are counted by key once and joined as a column.
Aggregates of one relation and one child query share one grouping.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import InvalidArgument, Unsupported
from ..functions.expressions import COMPARISONS, Cond, fold
from ..schema import Relation, snake

if TYPE_CHECKING:
    from .query import Query


class Has:
    """A test of a row's related rows; stands in a query's conditions."""

    def __init__(self, relation: str, child: Any = None, op: str = ">=", n: int = 1, negated: bool = False):
        if op not in COMPARISONS:
            raise InvalidArgument(f"no operator {op}")
        self.relation, self.child, self.op, self.n, self.negated = relation, child, op, n, negated
        self.column: str | None = None

    @property
    def plain(self) -> bool:
        return (self.op, self.n) in ((">=", 1), (">", 0))

    def build(self, resolve: Any) -> Column:
        if self.column is None:
            raise InvalidArgument("a relation filter stands outside of a model query")
        test = COMPARISONS[self.op](F.coalesce(F.col(self.column), F.lit(0)), self.n)
        return ~test if self.negated else test


def children(query: Query, relation: Relation, child: Any, extra: tuple[str, ...] = ()) -> DataFrame:
    """Related rows with the key of their parent as __key; all columns of the child."""
    engine = query.engine
    if relation.kind == "dynamic_belongs_to":
        raise Unsupported("a dynamic belongs_to has no single target")
    target = engine.query_of(relation.target)
    if child is not None:
        target = child(target)
    target = target.all_columns()
    df = target.df()
    if relation.kind in ("belongs_to", "has_one", "has_many"):
        return df.withColumn("__key", F.col(relation.foreign))
    if relation.kind == "dynamic_has_many":
        return df.where(F.col(relation.type_column) == F.lit(relation.type_value)).withColumn("__key", F.col(relation.foreign))
    link = engine.catalog.load(relation.through)
    if relation.kind == "dynamic_many_to_many":
        link = link.where(F.col(relation.type_column) == F.lit(relation.type_value))
    link = link.select(F.col(relation.through_local).alias("__key"), F.col(relation.through_foreign).alias("__to"))
    return link.join(df, F.col("__to") == F.col(relation.foreign)).drop("__to")


def _find(parts: list[tuple[str, Any]]) -> list[Has]:
    found: list[Has] = []

    def walk(x: Any) -> None:
        if isinstance(x, Has):
            found.append(x)
        for y in getattr(x, "members", ()):
            walk(y)

    for _, c in parts:
        walk(c)
    return found


def prepare(query: Query, df: DataFrame, parts: list[tuple[str, Any]], cond: Cond) -> tuple[DataFrame, Cond | None]:
    """Turns relation filters into joins; returns what is left of the condition."""
    has = _find(parts)
    if not has:
        return df, cond
    flat = all(joiner == "and" for joiner, _ in parts)
    rest = []
    for joiner, c in parts:
        if flat and isinstance(c, Has) and c.plain:
            relation = query.model.relation(c.relation)
            keys = children(query, relation, c.child).select("__key")
            local = F.col(f"{query.name}.{query.model.column(relation.local)}")
            df = df.join(keys, local == F.col("__key"), "left_anti" if c.negated else "left_semi")
        else:
            rest.append((joiner, c))
    for i, c in enumerate(_find(rest)):
        relation = query.model.relation(c.relation)
        name = f"__has{i}"
        counts = children(query, relation, c.child).groupBy("__key").agg(F.count("*").alias(name)).withColumnRenamed("__key", f"{name}_key")
        local = F.col(f"{query.name}.{query.model.column(relation.local)}")
        df = df.join(counts, local == F.col(f"{name}_key"), "left")
        c.column = name
    return df, fold(rest)


def default_alias(fn: str, relation: str, field: str | None) -> str:
    return snake(relation) + (f"_{snake(field)}" if field else "") + f"_{fn}"


def with_aggregates(query: Query, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Joins all relation aggregates; those of one relation and child share one grouping."""
    groups: dict[tuple, list] = {}
    for a in query.spec.aggs:
        groups.setdefault((a.relation, a.child), []).append(a)
    columns: dict[str, Column] = {}
    for i, ((name, child), aggs) in enumerate(groups.items()):
        relation = query.model.relation(name)
        rows = children(query, relation, child)
        made = []
        for a in aggs:
            field = query.engine.registry.models[relation.target].column(a.field) if a.field else None
            made.append((F.count(F.lit(1)) if a.fn in ("count", "exists") else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](F.col(field))).alias(a.alias))
        key = f"__agg{i}"
        grouped = rows.groupBy(F.col("__key").alias(key)).agg(*made)
        local = F.col(f"{query.name}.{query.model.column(relation.local)}")
        df = df.join(grouped, local == F.col(key), "left").drop(key)
        for a in aggs:
            columns[a.alias] = F.coalesce(F.col(a.alias), F.lit(0)) if a.fn == "count" else F.coalesce(F.col(a.alias) > 0, F.lit(False)) if a.fn == "exists" else F.col(a.alias)
    return (df.withColumns(columns) if columns else df), [a.alias for a in query.spec.aggs]


def _order_keys(relation: Relation, child_query: Query) -> list[Column]:
    names = [(x, d) for x, d in child_query.spec.order] or [(x, False) for x in relation.order]
    pk = child_query.model.primary if child_query.model else None
    keys = [(F.col(child_query.model.column(x) if child_query.model else x), d) for x, d in names] + ([(F.col(pk), False)] if pk else [])
    return [k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys]


def _visible(query: Query, table: str, columns: list[str]) -> list[str]:
    hidden = query.engine.registry.models[table].hidden_columns
    return [c for c in columns if c not in hidden and not c.startswith("__")]


def with_loads(query: Query, df: DataFrame, columns: list[Column]) -> DataFrame:
    """Adds each loaded relation as a struct (one) or an array of structs (many, in order; empty if none)."""
    out = list(columns)
    for i, (path, child, limit) in enumerate(query.spec.loads):
        name, _, rest = path.partition(".")
        relation = query.model.relation(name)
        nested = (lambda q, c=child, r=rest: (c(q) if c and not r else q).with_(r, c) if r else c(q) if c else q) if rest or child else None
        key = f"__load{i}"
        local = F.col(f"{query.name}.{query.model.column(relation.local)}")
        if relation.kind == "dynamic_belongs_to":
            loaded = None
            for value, table in relation.types.items():  # an unknown type loads nothing
                rows = query.engine.query_of(table).all_columns().df()
                own = rows.select(F.lit(value).alias(f"{key}_type"), F.col(relation.foreign).alias(key), F.to_json(F.struct(*_visible(query, table, rows.columns))).alias(name))
                loaded = own if loaded is None else loaded.unionByName(own)
            type_ = F.col(f"{query.name}.{query.model.column(relation.type_column)}")
            df = df.join(loaded, (local == F.col(key)) & (type_ == F.col(f"{key}_type")), "left")
            out.append(F.col(name))
            continue
        target = query.engine.query_of(relation.target)
        asked = nested(target) if nested else target
        rows = children(query, relation, nested)
        visible = _visible(query, relation.target, rows.columns)
        order = _order_keys(relation, asked)
        most = 1 if not relation.many else limit
        number = F.row_number().over(W.partitionBy("__key").orderBy(*order)) if order else F.row_number().over(W.partitionBy("__key").orderBy(F.lit(1)))
        rows = rows.withColumn("__n", number)
        rows = rows.where(F.col("__n") <= most) if most is not None else rows
        if relation.many:
            packed = rows.groupBy(F.col("__key").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.struct(*visible).alias("row")))), lambda x: x["row"]).alias(name))
            df = df.join(packed, local == F.col(key), "left")
            out.append(F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType)).alias(name))
        else:
            packed = rows.select(F.col("__key").alias(key), F.struct(*visible).alias(name))
            df = df.join(packed, local == F.col(key), "left")
            out.append(F.col(name))
    return df.select(*out)


def of(query: Query, relation: Relation, instance: dict[str, Any]) -> Query:
    """The related rows of one parent row."""
    value = instance[relation.local]
    if relation.kind in ("belongs_to", "has_one", "has_many"):
        return query.where(relation.foreign, value)
    if relation.kind == "dynamic_has_many":
        return query.where(relation.foreign, value).where(relation.type_column, relation.type_value)
    if relation.kind == "dynamic_belongs_to":
        if relation.types.get(instance[relation.type_column]) != query.model.table:
            return query.where(Cond(lambda r: F.lit(False)))
        return query.where(relation.foreign, value)
    link = query.engine.catalog.load(relation.through).where(F.col(relation.through_local) == F.lit(value))
    if relation.kind == "dynamic_many_to_many":
        link = link.where(F.col(relation.type_column) == F.lit(relation.type_value))
    keys = link.select(relation.through_foreign)
    return query.where(Cond(lambda r: r(relation.foreign).isin(keys)))
