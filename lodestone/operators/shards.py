"""Shards as a computed column: modulo, hash and range strategies."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, ShardMismatch

# Fixed values of the FNV-1a hash of 64 bits.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


@dataclass(frozen=True)
class ModShard:
    column: str
    shards: int

    def key(self) -> Column:
        return F.pmod(F.col(self.column), F.lit(self.shards))

    def of(self, value: Any) -> int:
        return int(value) % self.shards

    def only(self, df: DataFrame, value: Any) -> DataFrame:
        """Only the shard of this value: pruned where the data is partitioned by shard."""
        if "shard" in df.columns:
            return df.where(F.col("shard") == F.lit(self.of(value)))
        return df.where(self.key() == F.lit(self.of(value)))


@dataclass(frozen=True)
class HashShard(ModShard):
    """FNV-1a of the value's text, in native arithmetic on two halves of 32 bits."""

    def key(self) -> Column:
        data = F.transform(F.split(F.hex(F.encode(F.col(self.column).cast("string"), "UTF-8")), "(?<=\\G..)"), lambda x: F.conv(x, 16, 10).cast("long"))
        low_prime, high_prime = FNV_PRIME & 0xFFFFFFFF, FNV_PRIME >> 32
        start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))

        def step(acc, byte):
            lo = acc["lo"].bitwiseXOR(F.coalesce(byte, F.lit(0)))
            small = lo * F.lit(low_prime)
            hi = (F.shiftrightunsigned(small, 32) + acc["hi"] * F.lit(low_prime) + lo * F.lit(high_prime)).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.struct(hi.alias("hi"), small.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

        whole = F.aggregate(F.filter(data, lambda x: x.isNotNull()), start, step)
        # (hi * 2^32 + lo) mod n, without going beyond 64 bits
        n = F.lit(self.shards)
        return ((whole["hi"] % n) * F.lit((1 << 32) % self.shards) + whole["lo"] % n) % n

    def of(self, value: Any) -> int:
        h = FNV_OFFSET
        for b in str(value).encode():
            h = (h ^ b) * FNV_PRIME % (1 << 64)
        return h % self.shards


@dataclass(frozen=True)
class RangeShard:
    """Inclusive ranges of integers, in order; a value in none is an error on writing."""

    column: str
    ranges: tuple[tuple[int, int], ...]

    def key(self) -> Column:
        out = F.lit(None).cast("int")
        for i, (low, high) in reversed(list(enumerate(self.ranges))):
            out = F.when(F.col(self.column).between(low, high), F.lit(i)).otherwise(out)
        return out

    def of(self, value: Any) -> int:
        for i, (low, high) in enumerate(self.ranges):
            if low <= int(value) <= high:
                return i
        raise InvalidArgument(f"{value} is in no shard")

    def only(self, df: DataFrame, value: Any) -> DataFrame:
        low, high = self.ranges[self.of(value)]
        return df.where(F.col(self.column).between(low, high))


def fan_out(frames: list[DataFrame]) -> DataFrame:
    """All shards as one frame; order, offset and limit then hold globally."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def check_write(strategy: Any, old: dict[str, Any] | None, new: dict[str, Any], shard: Any) -> None:
    """A written row must belong to the chosen shard, and its key must not change."""
    if strategy.column in new:
        if strategy.of(new[strategy.column]) != strategy.of(shard):
            raise ShardMismatch(f"{strategy.column} = {new[strategy.column]} isn't in that shard")
        if old is not None and old.get(strategy.column) != new[strategy.column]:
            raise ShardMismatch("a shard key can't be changed")


def guarded(rows: DataFrame, strategy: Any, shard: Any) -> DataFrame:
    """Bulk rows that belong to the chosen shard; one that doesn't is an error when it is written."""
    if strategy.column not in rows.columns:
        return rows
    right = strategy.key() == F.lit(strategy.of(shard))
    wrong = F.raise_error(F.concat(F.lit(f"{strategy.column} isn't in that shard: "), F.coalesce(F.col(strategy.column).cast("string"), F.lit("null"))))
    return rows.withColumn(strategy.column, F.when(F.coalesce(right, F.lit(False)), F.col(strategy.column)).otherwise(wrong.cast(rows.schema[strategy.column].dataType)))
