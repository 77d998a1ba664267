"""The session: registered models, tables, scopes and services."""

from __future__ import annotations

import copy
import time as clock
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidQuery, UnknownRelation, WriteConflict
from .functions.expressions import bind
from .functions.extras import Cache, Events
from .operators.query import Query
from .schema import Model, Registry
from .sources.catalog import Catalog, Connection


class RawQuery:
    """SQL text with ? arguments over the engine's tables."""

    def __init__(self, engine: Engine, sql: str, args: tuple[Any, ...], many: bool = False):
        if ";" in sql.strip().rstrip(";") and not many:
            raise InvalidQuery("several statements")
        self.engine, self.sql, self.args = engine, sql, args

    def df(self) -> DataFrame:
        self.engine.register_views()
        return self.engine.spark.sql(bind(self.sql.strip().rstrip(";"), self.args))

    def scalar_column(self):
        return self.df().scalar()

    def get(self) -> list:
        return self.df().collect()

    def first(self):
        rows = self.df().take(1)
        return rows[0] if rows else None

    def stream(self):
        return self.df().toLocalIterator()

    def exec(self) -> int:
        """Runs a statement; the number of rows that it returns (0 for one that only changes something), counted by the cluster."""
        return self.df().count()

    def map_to(self, make: type) -> list[Any]:
        return [make(**r.asDict(recursive=True)) for r in self.get()]


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, connections: dict[str, Connection] | None = None, prefix: str = ""):
        own = dict(connections or {})
        if path is not None:
            own.setdefault("default", Connection("parquet", path))
        self.spark, self.catalog, self.registry = spark, Catalog(spark, own, prefix), Registry()
        self.cache, self.events, self.state = Cache(), Events(), {}
        self.tenant_resolver: Callable[[], dict[str, Any]] | None = None
        self._tenant: dict[str, Any] = {}
        self._connection: str | None = None
        self.in_transaction = False
        self.extensions: dict[str, Any] = {}

    # set-up

    def register(self, *models: Model) -> Engine:
        self.registry.register(*models)
        return self

    def with_extension(self, name: str, extension: Any) -> Engine:
        """Adds an extension: an object with any of these methods.

        install(engine); on_query(engine, query) -> query; on_write(engine, context);
        connection(engine, table) -> name or None; shard_values(engine) and
        cache_key(engine) -> dict; events() -> handlers by name; state() -> anything.
        """
        if name in self.extensions:
            raise InvalidQuery(f"extension {name} is there already")
        self.extensions[name] = extension
        if hasattr(extension, "install"):
            extension.install(self)
        for event, handler in extension.events().items() if hasattr(extension, "events") else ():
            self.events.on(event, handler)
        if hasattr(extension, "state"):
            self.state[name] = extension.state()
        return self

    def asked(self, method: str) -> dict[str, Any]:
        """What all extensions answer to shard_values or cache_key, together."""
        return {k: v for x in self.extensions.values() if hasattr(x, method) for k, v in getattr(x, method)(self).items()}

    def _connection_of(self, table: str, model: Model | None) -> str | None:
        asked = (x.connection(self, table) for x in self.extensions.values() if hasattr(x, "connection"))
        return self._connection or (model.connection if model else None) or next((name for name in asked if name), None)

    def tenant(self, **values: Any) -> Engine:
        """A session whose reads and writes are limited to these tenant values."""
        out = copy.copy(self)
        out._tenant = {**self._tenant, **values}
        return out

    def connection(self, name: str) -> Engine:
        if name not in self.catalog.connections:
            from .errors import UnknownConnection

            raise UnknownConnection(name)
        out = copy.copy(self)
        out._connection = name
        return out

    def tenant_values(self) -> dict[str, Any]:
        return {**(self.tenant_resolver() if self.tenant_resolver else {}), **self._tenant}

    # queries

    def query_of(self, table: str) -> Query:
        model = self.registry.models.get(table)
        return Query(self, lambda: self.catalog.load(table, self._connection_of(table, model)), table.rpartition(".")[2], model)

    def use(self, model: Model | str) -> Query:
        table = model if isinstance(model, str) else model.table
        if table not in self.registry.models:
            raise UnknownRelation(f"{table} isn't registered")
        return self.query_of(table)

    def table(self, name: str) -> Query:
        """A table by columns; registered tables keep their tenant and deletion scopes."""
        name, _, alias = name.partition(" ")
        model = self.registry.models.get(name)
        query = self.query_of(name)
        if model is not None:
            scoped = Query(self, query.source, query._name, _scopes_only(model))
            return scoped.as_(alias) if alias else scoped
        return query.as_(alias) if alias else query

    def from_(self, source: Query | DataFrame, alias: str) -> Query:
        return Query(self, (lambda: source) if isinstance(source, DataFrame) else source.df, alias)

    def raw(self, sql: str, *args: Any, many: bool = False) -> RawQuery:
        return RawQuery(self, sql, args, many)

    def register_views(self) -> None:
        for table in self.catalog.frames:
            self.catalog.load(table).createOrReplaceTempView(table)

    def views(self, *tables: str) -> Engine:
        """Makes tables known to raw SQL."""
        for t in tables:
            self.catalog.load(t).createOrReplaceTempView(t)
        return self

    @contextmanager
    def transaction(self, store: Any):
        """Writes to a store's tables take effect together at the end, or not at all."""
        was, self.in_transaction = self.in_transaction, True
        try:
            with store.transaction() as staged:
                yield staged
        except BaseException:
            if not was:
                self.events.emit("after_rollback", {})
            raise
        finally:
            self.in_transaction = was
        if not was:
            self.events.emit("after_commit", {})

    def run(self, store: Any, fn: Callable[[Any], Any], attempts: int = 3, wait: float = 0.05) -> Any:
        """Runs fn in a transaction, again where another writer was faster, with growing pauses."""
        for attempt in range(attempts):
            try:
                with self.transaction(store) as staged:
                    return fn(staged)
            except WriteConflict:
                if attempt + 1 == attempts or self.in_transaction:
                    raise
                clock.sleep(wait * 2**attempt)


class _Loose(Model):
    """A model that lends a table query its scopes, and nothing else: names are columns, all columns are read."""

    mark: str | None = None

    @property
    def deleted(self) -> str | None:
        return self.mark

    def column(self, name: str) -> str:
        return name

    @property
    def default_columns(self) -> list[str]:
        return []

    @property
    def hidden_columns(self) -> set[str]:
        return set()


def _scopes_only(model: Model) -> Model:
    out = _Loose(model.table, connection=model.connection)
    out.tenant, out.shard = tuple(model.column(t) for t in model.tenant), model.shard
    out.mark = model.deleted
    return out
