"""Row-level writes as pure changes of a DataFrame: old rows and inputs in, new rows out.

Every function returns the new table; `affected` counts in one pass over the
old one.  A condition that is unknown (NULL) matches no row.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, StaleData, UnsafeWrite
from ..functions.expressions import Cond, Increment, Raw, value_of
from ..plans.materialize import written
from ..schema import Model


@dataclass
class Change:
    """A new table and how many rows were changed.

    ids: the keys of rows that were given one by one; rows: the changed rows as
    they are now (as they were, where they were removed), for bulk writes too.
    """

    table: DataFrame
    affected: int
    ids: list[Any] = field(default_factory=list)
    rows: DataFrame | None = None

    @property
    def first_id(self) -> Any:
        return self.ids[0] if self.ids else None


def _truth(cond: Cond) -> Column:
    return F.coalesce(cond.build(F.col), F.lit(False))


def _numbered(rows: DataFrame, key: str, base: int) -> DataFrame:
    """Missing keys follow base by the row's place: partitions are counted, then each row adds its place inside, without a shuffle."""
    placed = written(rows.withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__many"))
    before = F.coalesce(F.sum("__many").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # a row of two numbers per partition
    number = (F.lit(base) + F.col("__before") + inside + 1).cast(rows.schema[key].dataType)
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn(key, F.coalesce(F.col(key), number)).select(*rows.columns)


def insert(table: DataFrame, rows: DataFrame, model: Model | None = None, now: dt.datetime | None = None, only: tuple[str, ...] = (), omit: tuple[str, ...] = (), tenant: dict[str, Any] | None = None, few: bool = False) -> Change:
    """Appends rows; missing columns get the model's defaults, missing keys follow the largest one.

    few: the rows were given one by one on the driver; only then their keys are listed.
    """
    if only:
        rows = rows.select(*[c for c in rows.columns if c in only])
    rows = rows.drop(*omit)
    for k, v in (tenant or {}).items():
        rows = rows.withColumn(k, F.lit(v))
    pk = model.primary if model else None
    if pk and pk not in rows.columns:
        rows = rows.withColumn(pk, F.lit(None).cast(table.schema[pk].dataType))
    if pk and isinstance(table.schema[pk].dataType, T.IntegralType):
        rows = rows.withColumn(pk, F.col(pk).cast(table.schema[pk].dataType))
        base = table.select(pk).unionByName(rows.select(pk)).agg(F.coalesce(F.max(pk), F.lit(0)).alias("m")).first()["m"]
        rows = _numbered(rows, pk, base)
    stamp = F.lit((now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None).isoformat(sep=" "))
    made = {}
    for f in table.schema.fields:
        own = model.by_column(f.name) if model else None
        if f.name in rows.columns:
            value = F.col(f.name).cast(f.dataType)
            made[f.name] = F.coalesce(value, stamp.cast(f.dataType)) if own and own.auto_create else value
        elif own and own.auto_create:
            made[f.name] = stamp.cast(f.dataType)
        elif own and own.default is not None:
            made[f.name] = F.lit(own.default).cast(f.dataType)
        else:
            made[f.name] = F.lit(None).cast(f.dataType)
    extra = [c for c in rows.columns if c not in table.columns]
    if extra:
        raise InvalidArgument(f"the table has no {extra}")
    if model:
        rows = _validated(rows, model)
    new = rows.select(*[v.alias(k) for k, v in made.items()])
    ids = [r[0] for r in new.select(pk).collect()] if pk and few else []
    return Change(table.unionByName(new), len(ids) if ids else new.count(), ids, new)


def _validated(rows: DataFrame, model: Model) -> DataFrame:
    """Enumerations and sizes raise when a row breaks them."""
    for f in model.fields.values():
        if f.column not in rows.columns:
            continue
        bad = None
        if f.enum:
            bad = ~F.col(f.column).isin(*f.enum)
        elif f.size and f.logical in ("string", "text"):
            bad = F.char_length(F.col(f.column)) > f.size
        if bad is not None:
            rows = rows.withColumn(f.column, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{f.column}: not a valid value")).cast("string")).otherwise(F.col(f.column)))
    return rows


def update(table: DataFrame, cond: Cond | None, values: dict[str, Any], model: Model | None = None, now: dt.datetime | None = None, check_version: Any = None, only: tuple[str, ...] = ()) -> Change:
    """Sets columns where the condition holds; keys and creation times stay unless asked for by `only`."""
    if cond is None:
        raise UnsafeWrite("an update needs a condition")
    match = _truth(cond)
    sets = dict(values)
    if model and not only:
        skipped = {f.column for f in model.fields.values() if f.primary or (f.auto_create and not f.auto_update)}
        sets = {k: v for k, v in sets.items() if k not in skipped}
    if model:
        for f in model.fields.values():
            if f.auto_update and f.column in table.columns and f.column not in sets:
                sets[f.column] = (now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None)
        if check_version is not None:
            match = match & (F.col(model.version) == F.lit(check_version))
            sets[model.version] = Increment(1)
    made = {}
    for k, v in sets.items():
        if isinstance(v, Increment):
            v = Increment(v.by, k)
        made[k] = F.when(match, value_of(v, F.col).cast(table.schema[k].dataType)).otherwise(F.col(k))
    affected = table.where(match).count()
    if check_version is not None and not affected:
        raise StaleData(f"{model.table}: version {check_version} has passed")
    return Change(table.withColumns(made), affected, rows=table.where(match).withColumns(made))


def delete(table: DataFrame, cond: Cond | None, model: Model | None = None, force: bool = False, now: dt.datetime | None = None, also: dict[str, Any] | None = None) -> Change:
    """Removes rows; where the model has a deletion mark, sets it (and `also`) instead."""
    if cond is None:
        raise UnsafeWrite("a delete needs a condition")
    if model and model.deleted and not force:
        live = Cond(lambda r: cond.build(r) & F.col(model.deleted).isNull())
        return update(table, live, {**(also or {}), model.deleted: (now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None)}, model, now)
    match = _truth(cond)
    return Change(table.where(~match), table.where(match).count(), rows=table.where(match))


def restore(table: DataFrame, cond: Cond | None, model: Model, now: dt.datetime | None = None, also: dict[str, Any] | None = None) -> Change:
    if cond is None:
        raise UnsafeWrite("a restore needs a condition")
    gone = Cond(lambda r: cond.build(r) & F.col(model.deleted).isNotNull())
    return update(table, gone, {**(also or {}), model.deleted: None}, model, now)


class Conflict:
    """What happens where an input row meets an old row with the same keys."""

    def __init__(self, *keys: str):
        if not keys:
            raise InvalidArgument("an upsert needs its conflict columns")
        self.keys, self.action, self.columns, self.values = keys, "nothing", (), {}

    def do_nothing(self) -> Conflict:
        return self

    def update(self, *columns: str) -> Conflict:
        self.action, self.columns = "columns", columns
        return self

    def update_all(self) -> Conflict:
        self.action = "all"
        return self

    def update_map(self, values: dict[str, Any]) -> Conflict:
        self.action, self.values = "map", values
        return self


def upsert(table: DataFrame, rows: DataFrame, conflict: Conflict, model: Model | None = None, now: dt.datetime | None = None) -> Change:
    """One full outer join on the conflict columns; input rows must not repeat them."""
    keys = list(conflict.keys)
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise InvalidArgument("input rows repeat the conflict columns")
    extra = [c for c in rows.columns if c not in table.columns]
    if extra:
        raise InvalidArgument(f"the table has no {extra}")
    stamp = (now or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None)
    auto_create = {f.column for f in model.fields.values() if f.auto_create} if model else set()
    auto_update = {f.column for f in model.fields.values() if f.auto_update} if model else set()
    kept = set(keys) | ({model.primary} if model and model.primary else set()) | (auto_create - auto_update)
    old, new = table.withColumn("__old", F.lit(True)).alias("o"), rows.withColumn("__new", F.lit(True)).alias("n")
    on = None
    for k in keys:
        own = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = own if on is None else on & own
    both = F.col("__old") & F.col("__new")
    out = []
    for f in table.schema.fields:
        c = f.name
        given = F.col(f"n.{c}").cast(f.dataType) if c in rows.columns else F.lit(None).cast(f.dataType)
        fresh = given
        if c in auto_create:
            fresh = F.coalesce(given, F.lit(stamp).cast(f.dataType))
        elif model and model.by_column(c) and model.by_column(c).default is not None and c not in rows.columns:
            fresh = F.lit(model.by_column(c).default).cast(f.dataType)
        met = F.col(f"o.{c}")
        if conflict.action == "all" and c in rows.columns and c not in kept:
            met = given
        elif conflict.action == "columns" and c in conflict.columns:
            met = given
        elif conflict.action == "map" and c in conflict.values:
            v = conflict.values[c]
            resolve = lambda n: F.col(f"o.{n}")
            met = (Increment(v.by, c).build(resolve) if isinstance(v, Increment) else v.build(resolve) if isinstance(v, Raw) else value_of(v, resolve)).cast(f.dataType)
        if conflict.action != "nothing" and c in auto_update and c not in rows.columns:
            met = F.lit(stamp).cast(f.dataType)
        out.append(F.when(both, met).when(F.col("__new"), fresh).otherwise(F.col(f"o.{c}")).alias(c))
    joined = old.join(new, on, "full")
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    done = joined.select(*out)
    return Change(done, rows.count() if conflict.action != "nothing" else fresh.count(), rows=done.join((rows if conflict.action != "nothing" else fresh).select(*keys), keys, "left_semi"))


# links of relations


def attach(link: DataFrame, local: str, foreign: str, source: Any, targets: list[Any], data: dict[str, Any] | None = None, fixed: dict[str, Any] | None = None) -> Change:
    rows = link.sparkSession.createDataFrame([(t,) for t in targets], [foreign]).withColumn(local, F.lit(source))
    for k, v in {**(data or {}), **(fixed or {})}.items():
        rows = rows.withColumn(k, F.lit(v))
    return insert(link, rows)


def detach(link: DataFrame, local: str, foreign: str, source: Any, targets: list[Any] | None, fixed: dict[str, Any] | None = None) -> Change:
    def build(r):
        out = F.col(local) == F.lit(source)
        for k, v in (fixed or {}).items():
            out = out & (F.col(k) == F.lit(v))
        return out if targets is None else out & F.col(foreign).isin(*targets)

    return delete(link, Cond(build))


def sync(link: DataFrame, local: str, foreign: str, source: Any, targets: list[Any], detaching: bool = True, fixed: dict[str, Any] | None = None) -> Change:
    """Makes a source's links equal to the targets; without detaching, only adds the missing ones."""
    mine = link.where(F.col(local) == F.lit(source))
    for k, v in (fixed or {}).items():
        mine = mine.where(F.col(k) == F.lit(v))
    there = {r[0] for r in mine.select(foreign).collect()}  # one source's links
    gone = [t for t in there if t not in set(targets)] if detaching else []
    removed = detach(link, local, foreign, source, gone, fixed) if gone else Change(link, 0)
    missing = [t for t in dict.fromkeys(targets) if t not in there]
    added = attach(removed.table, local, foreign, source, missing, fixed=fixed) if missing else Change(removed.table, 0)
    return Change(added.table, removed.affected + added.affected)


def set_foreign(table: DataFrame, model: Model, keys: list[Any], foreign: str, value: Any, still: Any = None, type_: tuple[str, Any] | None = None) -> Change:
    """Points children at a parent (or at none, only while they still point at `still`), all in one pass."""

    def build(r):
        out = F.col(model.primary).isin(*keys)
        return out & (F.col(foreign) == F.lit(still)) if still is not None else out

    values = {foreign: value} | ({type_[0]: type_[1]} if type_ else {})
    return update(table, Cond(build), values, model)
