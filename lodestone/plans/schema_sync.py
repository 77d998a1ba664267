"""Differences between a model and a table, and the safe ones applied."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsafeSchemaChange
from ..schema import Model


@dataclass(frozen=True)
class SchemaChange:
    kind: str  # create_table, add_column, rename_column, create_index, unsafe
    column: str = ""
    to: str = ""
    why: str = ""


def diff(model: Model, current: T.StructType | None, last: T.StructType | None = None) -> list[SchemaChange]:
    """What the model needs; last: the schema of the last sync, for telling renames."""
    if current is None:
        return [SchemaChange("create_table")] + _indexes(model)
    have = {f.name: f for f in current.fields}
    want = {f.column: f for f in model.fields.values() if f.stored}
    gone = [c for c in have if c not in want and (last is None or c in last.names)]
    new = [c for c in want if c not in have]
    out, renamed = [], set()
    for c in new:
        alike = [g for g in gone if have[g].dataType == want[c].type and g not in renamed]
        rivals = [n for n in new if want[n].type == want[c].type]
        if last is not None and len(alike) == 1 and len(rivals) == 1:
            out.append(SchemaChange("rename_column", alike[0], c))
            renamed.add(alike[0])
        elif last is not None and len(alike) >= 1:
            out.append(SchemaChange("unsafe", c, why="several columns may be the old name"))
        elif not want[c].nullable and want[c].default is None:
            out.append(SchemaChange("unsafe", c, why="a new column without nulls needs a default"))
        else:
            out.append(SchemaChange("add_column", c))
    out += [SchemaChange("unsafe", g, why="the model has no such column") for g in gone if g not in renamed]
    for c, f in want.items():
        if c in have and have[c].dataType != f.type:
            out.append(SchemaChange("unsafe", c, why=f"{have[c].dataType.simpleString()} can't become {f.type.simpleString()}"))
    return out


def _indexes(model: Model) -> list[SchemaChange]:
    return [SchemaChange("create_index", f.column) for f in model.fields.values() if f.index or f.unique or f.full_text]


def apply(spark: SparkSession, model: Model, table: DataFrame | None, changes: list[SchemaChange]) -> DataFrame:
    """The table after the changes; an unsafe one is an error.  Indexes are only noted: Parquet has statistics instead."""
    for c in changes:
        if c.kind == "unsafe":
            raise UnsafeSchemaChange(f"{model.table}.{c.column}: {c.why}")
    if any(c.kind == "create_table" for c in changes):
        return spark.createDataFrame([], model.struct())
    for c in changes:
        if c.kind == "rename_column":
            table = table.withColumnRenamed(c.column, c.to)
        elif c.kind == "add_column":
            f = model.by_column(c.column)
            value: Any = F.lit(f.default).cast(f.type)
            table = table.withColumn(c.column, value)
    return table


def check_unique(table: DataFrame, model: Model) -> list[str]:
    """Unique columns that hold a value twice."""
    return [f.column for f in model.fields.values() if f.unique and not table.where(F.col(f.column).isNotNull()).groupBy(f.column).count().where("count > 1").isEmpty()]
