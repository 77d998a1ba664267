"""The fluent query surface over models, tables and other queries.

A query is immutable; every verb returns a changed copy, and nothing runs
before a terminal verb (get, first, count, ...).  `df()` gives the DataFrame.
"""

from __future__ import annotations

import decimal
import math
import time as clock
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidQuery, OrderRequired, Unsupported
from ..functions.expressions import COMPARISONS, Agg, Cond, Name, Raw, compare_columns, condition, exists, fold, in_query, value_of
from ..plans.lowering import lower
from ..plans.spec import Join, RelationAgg, Spec
from ..schema import Model
from .relations import Has, default_alias
from .relations import of as related_of


class Group:
    """Collects conditions in parentheses; also a join's ON."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, Any]] = []

    def where(self, *args: Any) -> Group:
        self.parts.append(("and", condition(args)))
        return self

    def or_where(self, *args: Any) -> Group:
        self.parts.append(("or", condition(args)))
        return self

    def on_column(self, left: str, *args: str) -> Group:
        op, right = args if len(args) == 2 else ("=", args[0])
        self.parts.append(("and", compare_columns(left, op, right)))
        return self

    def or_on_column(self, left: str, *args: str) -> Group:
        op, right = args if len(args) == 2 else ("=", args[0])
        self.parts.append(("or", compare_columns(left, op, right)))
        return self

    where_column, or_where_column = on_column, or_on_column

    def where_group(self, fn: Callable[[Group], Any]) -> Group:
        return self._group("and", fn)

    def or_where_group(self, fn: Callable[[Group], Any]) -> Group:
        return self._group("or", fn)

    def _group(self, joiner: str, fn: Callable[[Group], Any]) -> Group:
        inner = Group()
        fn(inner)
        if inner.parts:  # an empty group counts for nothing
            self.parts.append((joiner, inner.folded()))
        return self

    def where_when(self, flag: bool, fn: Callable[[Group], Any]) -> Group:
        return self.where_group(fn) if flag else self

    def where_raw(self, sql: str, *args: Any) -> Group:
        self.parts.append(("and", Raw(sql, *args)))
        return self

    def or_where_raw(self, sql: str, *args: Any) -> Group:
        self.parts.append(("or", Raw(sql, *args)))
        return self

    def where_in(self, name: str, query: Any) -> Group:
        self.parts.append(("and", Cond(lambda r: in_query(r(name), query))))
        return self

    def or_where_in(self, name: str, query: Any) -> Group:
        self.parts.append(("or", Cond(lambda r: in_query(r(name), query))))
        return self

    def where_exists(self, query: Any) -> Group:
        self.parts.append(("and", exists(query)))
        return self

    def or_where_exists(self, query: Any) -> Group:
        self.parts.append(("or", exists(query)))
        return self

    def where_has(self, relation: str, child: Any = None, op: str = ">=", n: int = 1) -> Group:
        self.parts.append(("and", Has(relation, child, op, n)))
        return self

    def or_where_has(self, relation: str, child: Any = None, op: str = ">=", n: int = 1) -> Group:
        self.parts.append(("or", Has(relation, child, op, n)))
        return self

    def folded(self) -> Cond | None:
        cond = fold(self.parts)
        if cond is not None:
            cond.members = [c for _, c in self.parts]
        return cond


@dataclass
class Page:
    items: list[Row]
    total: int
    page: int
    size: int

    @property
    def pages(self) -> int:
        return math.ceil(self.total / self.size)


class Paginator:
    def __init__(self, query: Query, size: int):
        if size < 1:
            raise InvalidArgument("a page has one row at least")
        if query.spec.limit is not None or query.spec.offset is not None:
            raise InvalidQuery("a paginated query has no limit or offset of its own")
        self.query, self.size = query, size

    def page_df(self, page: int) -> DataFrame:
        if page < 1:
            raise InvalidArgument("pages count from 1")
        return self.query.offset((page - 1) * self.size).limit(self.size).df()

    def page(self, page: int) -> Page:
        return Page(self.page_df(page).collect(), self.query.count(), page, self.size)

    def each_page(self) -> Iterator[list[Row]]:
        """All pages of one run of the query."""
        held: list[Row] = []
        for row in self.query.stream():
            held.append(row)
            if len(held) == self.size:
                yield held
                held = []
        if held:
            yield held


class Query:
    def __init__(self, engine: Any, source: Callable[[], DataFrame], name: str, model: Model | None = None, spec: Spec | None = None):
        self.engine, self.source, self.model, self.spec = engine, source, model, spec or Spec()
        self._name = name

    @property
    def name(self) -> str:
        return self.spec.alias or self._name

    def _but(self, **changes: Any) -> Query:
        return Query(self.engine, self.source, self._name, self.model, self.spec.but(**changes))

    def _also(self, part: str, *more: Any) -> Query:
        return self._but(**{part: (*getattr(self.spec, part), *more)})

    # conditions

    def where(self, *args: Any) -> Query:
        return self._also("where", ("and", condition(args)))

    def or_where(self, *args: Any) -> Query:
        return self._also("where", ("or", condition(args)))

    def _grouped(self, joiner: str, fn: Callable[[Group], Any]) -> Query:
        group = Group()
        fn(group)
        return self._also("where", (joiner, group.folded())) if group.parts else self

    def where_group(self, fn: Callable[[Group], Any]) -> Query:
        return self._grouped("and", fn)

    def or_where_group(self, fn: Callable[[Group], Any]) -> Query:
        return self._grouped("or", fn)

    def where_when(self, flag: bool, fn: Callable[[Group], Any]) -> Query:
        return self.where_group(fn) if flag else self

    def where_raw(self, sql: str, *args: Any) -> Query:
        return self.where(Raw(sql, *args))

    def where_column(self, left: str, *args: str) -> Query:
        op, right = args if len(args) == 2 else ("=", args[0])
        return self.where(compare_columns(left, op, right))

    def where_in(self, name: str, query: Any) -> Query:
        return self.where(Cond(lambda r: in_query(r(name), query)))

    def where_exists(self, query: Any) -> Query:
        return self.where(exists(query))

    def where_has(self, relation: str, child: Any = None, op: str = ">=", n: int = 1) -> Query:
        return self.where(Has(relation, child, op, n))

    def or_where_has(self, relation: str, child: Any = None, op: str = ">=", n: int = 1) -> Query:
        return self.or_where(Has(relation, child, op, n))

    def where_doesnt_have(self, relation: str, child: Any = None, op: str = ">=", n: int = 1) -> Query:
        return self.where(Has(relation, child, op, n, negated=True))

    def or_where_doesnt_have(self, relation: str, child: Any = None, op: str = ">=", n: int = 1) -> Query:
        return self.or_where(Has(relation, child, op, n, negated=True))

    # sources

    def as_(self, alias: str) -> Query:
        return self._but(alias=alias)

    def _join(self, kind: str, source: Any, on: Callable[[Group], Any] | None, alias: str | None) -> Query:
        group = Group()
        if on is not None:
            on(group)
        return self._also("joins", Join(kind, source, alias, tuple(group.parts)))

    def join(self, source: Any, on: Callable[[Group], Any], alias: str | None = None) -> Query:
        return self._join("inner", source, on, alias)

    def left_join(self, source: Any, on: Callable[[Group], Any], alias: str | None = None) -> Query:
        return self._join("left", source, on, alias)

    def right_join(self, source: Any, on: Callable[[Group], Any], alias: str | None = None) -> Query:
        return self._join("right", source, on, alias)

    def full_join(self, source: Any, on: Callable[[Group], Any], alias: str | None = None) -> Query:
        return self._join("full", source, on, alias)

    def cross_join(self, source: str, alias: str | None = None) -> Query:
        return self._join("cross", source, None, alias)

    def join_raw(self, kind: str, source: str, sql: str, *args: Any, alias: str | None = None) -> Query:
        return self._also("joins", Join(kind, source, alias, (("and", Raw(sql, *args)),)))

    # columns

    def select(self, *items: Any) -> Query:
        return self._also("select", *items)

    def select_hidden(self, *names: str) -> Query:
        return self._also("hidden", *names)

    def all_columns(self) -> Query:
        """With the hidden columns, for the engine's own joins."""
        if self.model is None or self.spec.select:
            return self
        return self._but(hidden=tuple(dict.fromkeys([*self.spec.hidden, *(f.name for f in self.model.fields.values() if f.hidden)])))

    # groups

    def group_by(self, *names: str) -> Query:
        return self._also("group", *names)

    def having(self, left: Any, *args: Any) -> Query:
        op, right = args if len(args) == 2 else ("=", args[0])
        side = lambda x, found: found[x] if isinstance(x, Agg) else F.col(x.rpartition(".")[2]) if isinstance(x, str) else x
        right_side = lambda found: found[right] if isinstance(right, Agg) else value_of(right, F.col)
        return self._also("having", ("test", (lambda found: COMPARISONS[op](side(left, found), right_side(found)), (left, right))))

    def having_column(self, left: Any, *args: Any) -> Query:
        op, right = args if len(args) == 2 else ("=", args[0])
        side = lambda x, found: found[x] if isinstance(x, Agg) else F.col(x.rpartition(".")[2])
        return self._also("having", ("test", (lambda found: COMPARISONS[op](side(left, found), side(right, found)), (left, right))))

    def having_in(self, left: Any, query: Any) -> Query:
        side = lambda x, found: found[x] if isinstance(x, Agg) else F.col(x)
        return self._also("having", ("test", (lambda found: in_query(side(left, found), query), (left,))))

    def having_exists(self, query: Any) -> Query:
        return self._also("having", ("test", (lambda found: exists(query).build(F.col), ())))

    def having_raw(self, sql: str, *args: Any) -> Query:
        return self._also("having", ("raw", Raw(sql, *args)))

    # order and size

    def order_by(self, *names: str) -> Query:
        return self._also("order", *[(n, False) for n in names])

    def order_by_desc(self, *names: str) -> Query:
        return self._also("order", *[(n, True) for n in names])

    def order_by_raw(self, sql: str, *args: Any, desc: bool = False) -> Query:
        return self._also("order", (Raw(sql, *args), desc))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise InvalidArgument("a limit isn't negative")
        return self._but(limit=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise InvalidArgument("an offset isn't negative")
        return self._but(offset=n)

    # relations

    def with_(self, relation: str, child: Any = None, limit: int | None = None) -> Query:
        """Eager load; dots nest; limit: rows per parent."""
        self.model.relation(relation.partition(".")[0])
        return self._also("loads", (relation, child, limit))

    def _with_agg(self, fn: str, relation: str, field: str | None, child: Any, alias: str | None) -> Query:
        self.model.relation(relation)
        return self._also("aggs", RelationAgg(fn, relation, field, alias or default_alias(fn if fn != "exists" else "exists", relation, field), child))

    def with_count(self, relation: str, child: Any = None, alias: str | None = None) -> Query:
        return self._with_agg("count", relation, None, child, alias)

    def with_exists(self, relation: str, child: Any = None, alias: str | None = None) -> Query:
        return self._with_agg("exists", relation, None, child, alias)

    def with_sum(self, relation: str, field: str, child: Any = None, alias: str | None = None) -> Query:
        return self._with_agg("sum", relation, field, child, alias)

    def with_avg(self, relation: str, field: str, child: Any = None, alias: str | None = None) -> Query:
        return self._with_agg("avg", relation, field, child, alias)

    def with_min(self, relation: str, field: str, child: Any = None, alias: str | None = None) -> Query:
        return self._with_agg("min", relation, field, child, alias)

    def with_max(self, relation: str, field: str, child: Any = None, alias: str | None = None) -> Query:
        return self._with_agg("max", relation, field, child, alias)

    def for_(self, parent: Model, relation: str, instance: Row | dict[str, Any]) -> Query:
        """Only the rows related to one parent row."""
        instance = instance.asDict() if isinstance(instance, Row) else instance
        return related_of(self, parent.relation(relation), instance)

    # scopes

    def scope(self, *fns: Callable[[Query], Query]) -> Query:
        out = self
        for fn in fns:
            out = fn(out)
        return out

    def scope_when(self, flag: bool, *fns: Callable[[Query], Query]) -> Query:
        return self.scope(*fns) if flag else self

    def apply(self, *plugins: Any) -> Query:
        """Plugins: objects with any of on_query(query) -> query before a read, on_rows(rows) -> rows after one, on_write(context) around writes (see WriteContext), finish(query) after all others."""
        return self._also("plugins", *plugins)

    def with_deleted(self) -> Query:
        return self._but(deleted="with")

    def only_deleted(self) -> Query:
        return self._but(deleted="only")

    def shard(self, value: Any) -> Query:
        return self._but(shard=value)

    def all_shards(self) -> Query:
        return self._but(all_shards=True, shard=None)

    def use_primary(self) -> Query:
        """Reads are of one snapshot anyway."""
        return self

    def lock_for_update(self) -> Query:
        if not self.engine.in_transaction:
            raise Unsupported("a lock needs a transaction")
        return self

    lock_for_share = lock_for_update

    def skip_hooks(self) -> Query:
        return self._but(skip_hooks=True)

    def skip_events(self) -> Query:
        return self._but(skip_events=True)

    def cache(self, ttl: float) -> Query:
        return self._but(cache_ttl=ttl)

    def cache_key(self, key: str) -> Query:
        return self._but(cache_key=key)

    def cache_tags(self, *tags: str) -> Query:
        return self._but(cache_tags=(*self.spec.cache_tags, *tags))

    def timeout(self, seconds: float) -> Query:
        """The shorter of all timeouts holds."""
        return self._but(timeout=min(seconds, self.spec.timeout or seconds))

    # results

    def df(self) -> DataFrame:
        return lower(self)

    def scalar_column(self) -> Column:
        return self.df().scalar()

    def _rows(self, df: DataFrame) -> list[Row]:
        from ..functions import extras

        began, engine = clock.time(), self.engine
        emit = (lambda *a: None) if self.spec.skip_events else engine.events.emit

        def run() -> list[Row]:
            emit("before_sql", {"table": self._name})
            rows = extras.with_timeout(engine.spark, df.collect, self.spec.timeout)
            emit("after_sql", {"table": self._name, "rows": len(rows), "seconds": clock.time() - began})
            return rows

        if self.spec.cache_ttl is not None and not engine.in_transaction:
            key = self.spec.cache_key or extras.plan_key(df, {**engine.tenant_values(), **engine.asked("cache_key")})
            emit("after_cache_hit" if engine.cache.has(key) else "after_cache_miss", {"table": self._name, "key": key})
            rows = engine.cache.remember(key, self.spec.cache_ttl, self.spec.cache_tags, run)
        else:
            rows = run()
        for plugin in self.spec.plugins:
            if hasattr(plugin, "on_rows"):
                rows = plugin.on_rows(rows)
        if self.model is not None and not self.spec.skip_hooks:
            for fn in self.model.hooks.get("after_find", []):
                rows = [fn(r) or r for r in rows]
        for plugin in self.spec.plugins:
            if hasattr(plugin, "finish"):
                plugin.finish(self)
        emit("after_find", {"table": self._name, "rows": len(rows)})
        if not self.spec.skip_events:
            self.engine.events.emit("query", {"table": self._name, "rows": len(rows), "seconds": clock.time() - began})
        return rows

    def get(self) -> list[Row]:
        return self._rows(self.df())

    def first(self) -> Row | None:
        if self.spec.all_shards and not self.spec.order:
            raise OrderRequired("the first row over all shards needs an order")
        rows = self._rows(self.limit(1).df())
        return rows[0] if rows else None

    def find(self, key: Any) -> Row | None:
        if self.model is None or self.model.primary is None:
            raise InvalidQuery("find needs a primary key of one column")
        return self.where(self.model.primary, key).first()

    def count(self) -> int:
        """Rows, or groups; limit and offset don't count."""
        return self._but(order=(), limit=None, offset=None, loads=()).df().count()

    def exists(self) -> bool:
        return not self._but(order=(), loads=()).df().isEmpty()

    def _terminal(self, fn: str, name: str) -> Any:
        if self.spec.limit is not None or self.spec.offset is not None or self.spec.group:
            raise InvalidQuery(f"{fn} of a query with limit, offset or groups")
        if self.spec.all_shards and fn in ("sum", "avg", "min", "max") and self.model is None:
            raise Unsupported(f"{fn} over all shards")
        return self._but(order=(), select=(Agg(fn, name, "value"),), loads=(), aggs=()).df().first()["value"]

    def sum(self, name: str) -> decimal.Decimal:
        value = self._terminal("sum", name)
        return decimal.Decimal("0") if value is None else decimal.Decimal(str(value))

    def avg(self, name: str) -> decimal.Decimal:
        value = self._terminal("avg", name)
        return decimal.Decimal("0") if value is None else decimal.Decimal(str(value))

    def min(self, name: str) -> Any:
        return self._terminal("min", name)

    def max(self, name: str) -> Any:
        return self._terminal("max", name)

    def paginate(self, size: int) -> Paginator:
        return Paginator(self, size)

    def stream(self) -> Iterator[Row]:
        """Rows one after another, a partition at a time on the driver."""
        return self.df().toLocalIterator(prefetchPartitions=True)

    def chunk(self, size: int, fn: Callable[[list[Row]], Any]) -> None:
        """Batches in order (by primary key where no order is given)."""
        query = self
        if not self.spec.order:
            if self.model is None or self.model.primary is None:
                raise OrderRequired("chunks need an order or a primary key")
            query = self.order_by(self.model.primary)
        for rows in Paginator(query._but(limit=None, offset=None), size).each_page():
            fn(rows)

    def each(self, fn: Callable[[Row], Any], size: int = 1000) -> None:
        self.chunk(size, lambda rows: [fn(r) for r in rows])

    def map_to(self, make: type) -> list[Any]:
        """Rows as instances of a class with those fields."""
        return [make(**r.asDict(recursive=True)) for r in self.get()]


__all__ = ["Group", "Has", "Name", "Page", "Paginator", "Query"]
