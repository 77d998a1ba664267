"""Filters: tables of bitmaps that tell which rows can't have a partner, before rows are shuffled (DataFrame functions only).

A filter never says no to a row that has a partner.  A join still follows, so
that a yes too many costs time only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of a bitmap (that many bitmap_construct_agg makes), and bits of a filter for each key.
BITMAP_BITS, BITS_A_KEY = 32_768, 16
#: Bitmaps of 4 KB up to which a filter is broadcast (32 MB).
BROADCAST_BITMAPS = 8_192


def make_filter(rows: DataFrame, bitmaps: int) -> DataFrame:
    """bucket, bits: a bit for each row's short hash (a long)."""
    bit = F.pmod(F.shiftrightunsigned("short", 20), F.lit(BITMAP_BITS)).cast("long")
    return rows.select(F.pmod("short", F.lit(bitmaps)).alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def passing(rows: DataFrame, filter_: DataFrame, bitmaps: int, found: bool = True) -> DataFrame:
    """The rows (with a column short) whose bit is set in the filter, or, if not found, the others."""
    bit = F.pmod(F.shiftrightunsigned("short", 20), F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(bit, F.lit(8)))
    side = F.broadcast(filter_) if bitmaps <= BROADCAST_BITMAPS else filter_
    return rows.join(side, (F.pmod("short", F.lit(bitmaps)) == F.col("bucket")) & (is_set == 1), "left_semi" if found else "left_anti")


def bitmaps_for(n: int, most: int | None = None) -> int:
    need = max(1, -(-n * BITS_A_KEY // BITMAP_BITS))
    return need if most is None else min(need, most)


def near_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose column (a long) may be among the keys' own column of that name: all that are, and a few others.

    The filter stays within its bound; with very many keys more others pass.
    """
    hashed = keys.select(F.xxhash64(column).alias("short"))
    bitmaps = bitmaps_for(keys.count(), BROADCAST_BITMAPS)
    filter_ = stored(make_filter(hashed, bitmaps), "filter")
    return passing(rows.withColumn("short", F.xxhash64(column)), filter_, bitmaps).drop("short")
