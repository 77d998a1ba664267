"""Log retention: the newest rows by key, or rows younger than an age, stay."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Retention:
    """A row goes when it is beyond keep_last (by key, newest first) or older than keep_for."""

    keep_last: int | None = None
    keep_for: dt.timedelta | None = None
    key: str = "id"
    time: str = "occurred_at"
    scope: tuple[str, ...] = ()
    now: dt.datetime | None = None

    def _old(self) -> Column:
        if self.keep_for is None:
            return F.lit(False)
        now = self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return F.coalesce(F.col(self.time) < F.to_timestamp_ntz(F.lit((now - self.keep_for).isoformat(sep=" "))), F.lit(False))

    def _marked(self, table: DataFrame) -> DataFrame:
        if self.keep_last is None:
            return table.withColumn("__gone", self._old())
        if self.keep_last == 0:
            return table.withColumn("__gone", F.lit(True))
        if not self.scope:
            # the key of the last row that stays: a top-n, not a sort of all rows in one task
            least = table.select(F.col(self.key).alias("__k")).orderBy(F.col("__k").desc()).limit(self.keep_last).agg(F.min("__k"))
            return table.withColumn("__gone", (F.col(self.key) < least.scalar()) | self._old())
        rank = F.row_number().over(W.partitionBy(*self.scope).orderBy(F.col(self.key).desc()))
        return table.withColumn("__gone", (rank > self.keep_last) | self._old())

    def kept(self, table: DataFrame) -> DataFrame:
        return self._marked(table).where(~F.col("__gone")).drop("__gone")

    def expired(self, table: DataFrame) -> DataFrame:
        return self._marked(table).where("__gone").drop("__gone")


class EveryWrites:
    """Runs a retention after each n-th write of a table."""

    def __init__(self, retention: Retention, every: int):
        self.retention, self.every, self.n = retention, every, 0

    def after_write(self, table: DataFrame) -> DataFrame:
        self.n += 1
        return self.retention.kept(table) if self.n % self.every == 0 else table
