"""Write verbs for models and tables: changes of a snapshot store with scopes, hooks, events and plugins."""

from __future__ import annotations

import copy
import datetime as dt
import functools
import math
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, ShardMismatch, TenantMismatch, TenantRequired, UnsafeWrite, Unsupported
from ..functions.expressions import Cond
from ..schema import Model, Relation
from . import shards, writes
from .query import Query
from .writes import Change, Conflict


@dataclass
class WriteContext:
    """What plugins and extensions see of a write, and may change: the values (or bulk rows) before it, the change after it."""

    mode: str  # insert, update, delete, restore, after_write
    stage: str  # values, result
    table: str
    model: Model | None = None
    values: dict[str, Any] | list[dict[str, Any]] | None = None
    rows: DataFrame | None = None
    change: Change | None = None


class Writer:
    """Reads a table from the store, changes it and writes it back; readers of the engine see the store's tables.

    Every verb is a transaction of its own, or part of the one around it: a
    table, its links and the audit log change together.
    """

    def __init__(self, engine: Any, store: Any, audit: Any = None, now: Any = None):
        self.engine, self.store, self.audit = engine, store, audit
        self._now = now or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self._shard: Any = None

    def share(self, *tables: str) -> Writer:
        """Makes the engine read these tables from the store."""
        for t in tables:
            self.engine.catalog.put(t, lambda t=t: self.store.read(t))
        return self

    def _model(self, table: str) -> Model | None:
        return self.engine.registry.models.get(table)

    def _tenant(self, model: Model | None) -> dict[str, Any]:
        if model is None or not model.tenant:
            return {}
        values = self.engine.tenant_values()
        missing = [t for t in model.tenant if t not in values]
        if missing:
            raise TenantRequired(f"{model.table} needs {missing}")
        return {model.column(t): values[t] for t in model.tenant}

    def _hooks(self, model: Model | None, name: str, value: Any, skip: bool = False) -> Any:
        for fn in model.hooks.get(name, []) if model and not skip else []:
            value = fn(value) or value
        return value

    def _plugged(self, plugins: tuple, context: WriteContext) -> WriteContext:
        """Plugins of the query and write extensions of the engine, each with its chance to change the context."""
        for plugin in plugins:
            if hasattr(plugin, "on_write"):
                plugin.on_write(context)
        for extension in self.engine.extensions.values():
            if hasattr(extension, "on_write"):
                extension.on_write(self.engine, context)
        return context

    def _chosen(self, model: Model | None, shard: Any) -> None:
        """All writes of a transaction go to one shard."""
        if model is None or model.shard is None or shard is None:
            return
        part = model.shard.of(shard)
        if self.engine.in_transaction and self._shard is not None and self._shard[0] is self.store and self._shard[1] != part:
            raise ShardMismatch("a transaction writes to one shard")
        self._shard = (self.store, part) if self.engine.in_transaction else None

    def _done(self, table: str, operation: str, change: Change, skip: bool = False, plugins: tuple = ()) -> Change:
        model = self._model(table)
        self.store.write(table, change.table)
        if self.audit and self.audit.log_table and model is not None and change.rows is not None and change.affected:
            log = self.store.read(self.audit.log_table)
            self.store.write(self.audit.log_table, log.unionByName(self.audit.log(operation, model, change.rows, self._now())))
        self._plugged(plugins, WriteContext("after_write", "result", table, model, change=change))
        if not skip:
            payload = {"table": table, "operation": operation, "rows": change.affected}
            for event in ("write", f"after_{operation}"):
                self.engine.events.emit(event, payload)
        return change

    def _before(self, table: str, operation: str, skip: bool) -> None:
        if not skip:
            self.engine.events.emit(f"before_{operation}", {"table": table, "operation": operation})

    def _rows(self, table: str, rows: DataFrame | dict | Iterable[dict], batch_size: int | None = None) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        rows = [rows] if isinstance(rows, dict) else list(rows)
        if not rows:
            raise InvalidArgument("no rows")
        schema, model = self.store.read(table).schema, self._model(table)
        names = list(dict.fromkeys(k for r in rows for k in r))
        unknown = [n for n in names if n not in schema.names]
        if unknown:
            raise InvalidArgument(f"the table has no {unknown}")
        # rows may have different keys: what a row lacks gets the model's default
        lacking = {n: own.default for n in names if model and (own := model.by_column(n)) and own.default is not None}
        fields = [T.StructField(n, schema[n].dataType) for n in names]
        frame = self.engine.spark.createDataFrame([tuple(r.get(n, lacking.get(n)) for n in names) for r in rows], T.StructType(fields))
        return frame if batch_size is None else frame.coalesce(max(1, math.ceil(len(rows) / batch_size)))

    # whole rows

    def create(self, table: str, rows: DataFrame | dict | Iterable[dict], only: tuple[str, ...] = (), omit: tuple[str, ...] = (), shard: Any = None, skip_hooks: bool = False, skip_events: bool = False, batch_size: int | None = None, plugins: tuple = ()) -> Change:
        """Adds rows; keys, times, tenant and defaults are filled in.

        Rows given one by one may have different keys and are stamped by hooks;
        batch_size is about how many of them one task writes.  A DataFrame of
        any size is written as it is.
        """
        if batch_size is not None and batch_size <= 0:
            raise InvalidArgument("a batch has rows")
        model, few = self._model(table), not isinstance(rows, DataFrame)
        with self.store.transaction():
            self._before(table, "create", skip_events)
            self._chosen(model, shard)
            columns = self.store.read(table).columns
            if few:
                rows = [self._hooks(model, "before_create", dict(r), skip_hooks) for r in ([rows] if isinstance(rows, dict) else rows)]
                rows = self._plugged(plugins, WriteContext("insert", "values", table, model, values=rows)).values
                rows = [self.audit.stamp("create", r, columns) for r in rows] if self.audit else rows
                for r in rows if model and model.shard is not None and shard is not None else ():
                    shards.check_write(model.shard, None, r, shard)
            else:
                rows = self._plugged(plugins, WriteContext("insert", "values", table, model, rows=rows)).rows
                for k, v in (self.audit.stamp("create", {}, columns) if self.audit else {}).items():
                    rows = rows.withColumn(k, F.lit(v))
                if model and model.shard is not None and shard is not None:
                    rows = shards.guarded(rows, model.shard, shard)
            made = writes.insert(self.store.read(table), self._rows(table, rows, batch_size), model, self._now(), only, omit, self._tenant(model), few)
            out = self._done(table, "create", made, skip_events, plugins)
        self._hooks(model, "after_create", out, skip_hooks)
        return out

    def upsert(self, table: str, rows: DataFrame | dict | Iterable[dict], conflict: Conflict, skip_events: bool = True, shard: Any = None) -> Change:
        """Adds or changes rows by their conflict columns; runs no hooks and, unless asked, no events.

        With a tenant only its own rows are met; a key that another tenant holds is an error.
        """
        model, frame = self._model(table), self._rows(table, rows)
        with self.store.transaction():
            old, tenant = self.store.read(table), self._tenant(model)
            self._chosen(model, shard)
            if model and model.shard is not None and shard is not None:
                frame = shards.guarded(frame, model.shard, shard)
            for k, v in tenant.items():
                frame = frame.withColumn(k, F.lit(v).cast(old.schema[k].dataType))
            if tenant:
                theirs = functools.reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lit(v)) for k, v in tenant.items()])
                if not old.where(theirs).join(frame.select(*conflict.keys), list(conflict.keys), "left_semi").isEmpty():
                    raise TenantMismatch(f"{table}: a key belongs to another tenant")
                conflict = copy.copy(conflict)
                conflict.keys = (*conflict.keys, *[k for k in tenant if k not in conflict.keys])
            for k, v in (self.audit.stamp("update", {}, old.columns) if self.audit else {}).items():
                frame = frame.withColumn(k, F.lit(v).cast(old.schema[k].dataType))
            return self._done(table, "upsert", writes.upsert(old, frame, conflict, model, self._now()), skip_events)

    # by query

    def _matched(self, query: Query, deleted: str | None = None) -> tuple[str, Model | None, Cond]:
        """The condition of a query's rows: by primary key, so joins, relations and limits may take part."""
        if not query.spec.where:
            raise UnsafeWrite("a write needs a condition")
        table = query._name
        model = self._model(table)
        key = model.primary if model else None
        query = query._but(select=(), loads=(), aggs=(), order=query.spec.order if query.spec.limit is not None else (), **({"deleted": deleted} if deleted else {}))
        if key is None:
            own = self._tenant(model)  # a model without a key keeps its tenant's bounds
            return table, model, Cond(lambda r: functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in own.items()], _plain(query).build(r)))
        keys = query.select(key).df()
        return table, model, Cond(lambda r: F.col(key).isin(keys))

    def update(self, query: Query, values: dict[str, Any], check_version: Any = None, only: tuple[str, ...] = ()) -> Change:
        with self.store.transaction():
            table, model, cond = self._matched(query)
            self._before(table, "update", query.spec.skip_events)
            self._chosen(model, query.spec.shard)
            values = {model.column(k) if model else k: v for k, v in values.items()}
            values = self._hooks(model, "before_update", values, query.spec.skip_hooks)
            values = self._plugged(query.spec.plugins, WriteContext("update", "values", table, model, values=values)).values
            if model and model.shard is not None and model.shard.column in values:
                raise InvalidArgument("a shard key can't be changed")
            old = self.store.read(table)
            values = self.audit.stamp("update", values, old.columns) if self.audit else values
            out = self._done(table, "update", writes.update(old, cond, values, model, self._now(), check_version, only), query.spec.skip_events, query.spec.plugins)
        self._hooks(model, "after_update", out, query.spec.skip_hooks)
        return out

    def delete(self, query: Query, force: bool = False) -> Change:
        with self.store.transaction():
            table, model, cond = self._matched(query, "with" if force else None)
            self._before(table, "delete", query.spec.skip_events)
            self._chosen(model, query.spec.shard)
            self._hooks(model, "before_delete", query, query.spec.skip_hooks)
            also = self._plugged(query.spec.plugins, WriteContext("delete", "values", table, model, values={})).values
            old = self.store.read(table)
            also = self.audit.stamp("delete", also, old.columns) if self.audit else also
            out = self._done(table, "delete", writes.delete(old, cond, model, force, self._now(), also), query.spec.skip_events, query.spec.plugins)
        self._hooks(model, "after_delete", out, query.spec.skip_hooks)
        return out

    def force_delete(self, query: Query) -> Change:
        return self.delete(query, force=True)

    def restore(self, query: Query) -> Change:
        with self.store.transaction():
            table, model, cond = self._matched(query, "only")
            if model is None or model.deleted is None:
                raise Unsupported(f"{table} has no deletion mark")
            self._before(table, "restore", query.spec.skip_events)
            self._hooks(model, "before_restore", query, query.spec.skip_hooks)
            also = self._plugged(query.spec.plugins, WriteContext("restore", "values", table, model, values={})).values
            old = self.store.read(table)
            also = self.audit.stamp("restore", also, old.columns) if self.audit else also
            out = self._done(table, "restore", writes.restore(old, cond, model, self._now(), also), query.spec.skip_events, query.spec.plugins)
        self._hooks(model, "after_restore", out, query.spec.skip_hooks)
        return out

    # relations of one row

    def _relation(self, model: Model, name: str, *kinds: str) -> Relation:
        r = model.relation(name)
        if r.kind not in kinds:
            raise Unsupported(f"{r.kind} can't do this")
        return r

    @staticmethod
    def _key(row: Row | dict, column: str) -> Any:
        return row[column]

    def set(self, model: Model, row: Row | dict, name: str, target: Row | dict | None) -> Change:
        """belongs_to, has_one: points the foreign key at the other row (or at none)."""
        r = self._relation(model, name, "belongs_to", "has_one")
        if r.kind == "belongs_to":
            value = None if target is None else self._key(target, r.foreign)
            return self._done(model.table, "update", writes.set_foreign(self.store.read(model.table), model, [row[model.primary]], r.local, value))
        other = self._model(r.target)
        if target is None:
            cond = Cond(lambda _: F.col(r.foreign) == F.lit(row[r.local]))
            return self._done(r.target, "update", writes.update(self.store.read(r.target), cond, {r.foreign: None}, other, self._now()))
        return self._done(r.target, "update", writes.set_foreign(self.store.read(r.target), other, [target[other.primary]], r.foreign, row[r.local]))

    def unset(self, model: Model, row: Row | dict, name: str) -> Change:
        return self.set(model, row, name, None)

    def replace(self, model: Model, row: Row | dict, name: str, target: Row | dict) -> Change:
        """has_one: the old row lets go, the new one is set, together."""
        self._relation(model, name, "has_one")
        with self.store.transaction():
            self.unset(model, row, name)
            return self.set(model, row, name, target)

    def add(self, model: Model, row: Row | dict, name: str, *targets: Row | dict) -> Change:
        """Children point at the row, all in one pass over their table."""
        r = self._relation(model, name, "has_many", "dynamic_has_many")
        other, type_ = self._model(r.target), (r.type_column, r.type_value) if r.type_column else None
        return self._done(r.target, "update", writes.set_foreign(self.store.read(r.target), other, [t[other.primary] for t in targets], r.foreign, row[r.local], type_=type_))

    def remove(self, model: Model, row: Row | dict, name: str, *targets: Row | dict) -> Change:
        """Children that still point at the row lose their foreign key; they stay."""
        r = self._relation(model, name, "has_many", "dynamic_has_many")
        other, type_ = self._model(r.target), (r.type_column, None) if r.type_column else None
        return self._done(r.target, "update", writes.set_foreign(self.store.read(r.target), other, [t[other.primary] for t in targets], r.foreign, None, still=row[r.local], type_=type_))

    def _link(self, model: Model, name: str) -> tuple[Relation, dict[str, Any]]:
        r = self._relation(model, name, "many_to_many", "dynamic_many_to_many")
        return r, {r.type_column: r.type_value} if r.type_column else {}

    def attach(self, model: Model, row: Row | dict, name: str, *targets: Row | dict, data: dict[str, Any] | None = None) -> Change:
        r, fixed = self._link(model, name)
        return self._done(r.through, "create", writes.attach(self.store.read(r.through), r.through_local, r.through_foreign, row[r.local], [t[r.foreign] for t in targets], data, fixed))

    def detach(self, model: Model, row: Row | dict, name: str, *targets: Row | dict) -> Change:
        r, fixed = self._link(model, name)
        return self._done(r.through, "delete", writes.detach(self.store.read(r.through), r.through_local, r.through_foreign, row[r.local], [t[r.foreign] for t in targets], fixed))

    def update_through(self, model: Model, row: Row | dict, name: str, target: Row | dict, data: dict[str, Any]) -> Change:
        r, fixed = self._link(model, name)
        match = {r.through_local: row[r.local], r.through_foreign: target[r.foreign], **fixed}

        def build(_):
            out = F.lit(True)
            for k, v in match.items():
                out = out & (F.col(k) == F.lit(v))
            return out

        return self._done(r.through, "update", writes.update(self.store.read(r.through), Cond(build), data))

    def sync(self, model: Model, row: Row | dict, name: str, targets: list[Row | dict], detaching: bool = True) -> Change:
        r, fixed = self._link(model, name)
        return self._done(r.through, "sync", writes.sync(self.store.read(r.through), r.through_local, r.through_foreign, row[r.local], [t[r.foreign] for t in targets], detaching, fixed))

    def clear(self, model: Model, row: Row | dict, name: str) -> Change:
        """Takes all related rows off: links go, children lose their foreign key."""
        r = self._relation(model, name, "has_many", "dynamic_has_many", "many_to_many", "dynamic_many_to_many")
        if r.kind.endswith("many_to_many"):
            fixed = {r.type_column: r.type_value} if r.type_column else {}
            return self._done(r.through, "delete", writes.detach(self.store.read(r.through), r.through_local, r.through_foreign, row[r.local], None, fixed))
        type_ = (F.col(r.type_column) == F.lit(r.type_value)) if r.type_column else F.lit(True)
        cond = Cond(lambda _: (F.col(r.foreign) == F.lit(row[r.local])) & type_)
        return self._done(r.target, "update", writes.update(self.store.read(r.target), cond, {r.foreign: None} | ({r.type_column: None} if r.type_column else {}), self._model(r.target), self._now()))

    # retention

    def cleanup(self, table: str, retention: Any, batch: int = 1000) -> tuple[int, int]:
        """Deletes what a retention lets go; returns rows and the batches that they make."""
        old = self.store.read(table)
        gone = retention.expired(old).count()
        if gone:
            self._done(table, "delete", Change(retention.kept(old), gone))
        return gone, math.ceil(gone / batch)


def _plain(query: Query) -> Cond:
    from ..functions.expressions import fold

    return fold([("and" if i == 0 else j, c) for i, (j, c) in enumerate(query.spec.where)])


__all__ = ["Conflict", "WriteContext", "Writer"]
