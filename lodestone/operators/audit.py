"""Audit: who wrote a row, and a log table of changes without hidden values."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Model

# Columns stamped by each operation.
STAMPS = {"create": ("created_by", "updated_by"), "update": ("updated_by",), "delete": ("deleted_by", "updated_by"), "restore": ("updated_by",)}
LOG = "table string, key string, operation string, actor string, at timestamp_ntz, values string"


class Audit:
    """Stamps the rows that a Writer writes and, with a log table (columns LOG), notes every changed row there."""

    def __init__(self, actor: Any, log_table: str | None = None):
        """actor: a value, or a function that gives it."""
        self._actor, self.log_table = actor, log_table

    @property
    def actor(self) -> Any:
        return self._actor() if callable(self._actor) else self._actor

    def stamp(self, operation: str, values: dict[str, Any], columns: list[str]) -> dict[str, Any]:
        """The values of a write with the actor in the operation's columns that the table has."""
        out = {**values, **{c: self.actor for c in STAMPS[operation] if c in columns}}
        if operation == "restore" and "deleted_by" in columns:
            out["deleted_by"] = None
        return out

    def log(self, operation: str, model: Model, rows: DataFrame, at: dt.datetime) -> DataFrame:
        """Log rows of the changed rows: table, key, operation, actor, time, visible values as JSON."""
        shown = [c for c in rows.columns if c not in model.hidden_columns]
        key = F.col(model.primary).cast("string") if model.primary else F.lit(None).cast("string")
        return rows.select(
            F.lit(model.table).alias("table"), key.alias("key"), F.lit(operation).alias("operation"), F.lit(str(self.actor)).alias("actor"),
            F.to_timestamp_ntz(F.lit(at.replace(tzinfo=None).isoformat(sep=" "))).alias("at"), F.to_json(F.struct(*shown)).alias("values"),
        )
