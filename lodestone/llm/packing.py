"""Best-fit packing of token pieces into fixed sequences, with certified bin counts.

Documents become pieces of at most `capacity` tokens.  A full piece fills a
sequence; the others are dealt by hash into partitions of about PART_ITEMS
pieces, each packed by best-fit decreasing in one task.  Dual feasible
functions (the threshold family and the rounding family) give a lower bound of
each partition's sequences.  A partition that meets its bound is certified and
stays.  The others put the pieces of their unfilled sequences together, deal
them anew into fewer or freshly mixed partitions and pack them again; a round
that doesn't save sequences ends the exchange, and nothing else but certificates
does.

Defined cases: a null or empty text is a document of the end id alone; a
repeated row is packed as often as it occurs; a null identifier is passed on;
an empty table gives no rows.  A text of any length is encoded whole and cut into
pieces; the literal of a special token in a text is that token, as the library
has it by default.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, read_table, stored
from .textbuf import buffers
from .tokenize import default_path, word_encoder

CAPACITY = 2048
END_ID = 0
#: Pieces of a partition, about.
PART_ITEMS = 25_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, round int, part long, bin long, offset long, fill long, part_bins long, part_bound long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_encoder(path), struct.pack("<I", end_id)
        for batch in batches:
            ids, counts = encoder.encode(*buffers(batch.column("text")))
            ends, raw = np.cumsum(counts), ids.astype("<u4").tobytes()
            row, piece, start, length, crc = [], [], [], [], []
            for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                own = raw[4 * (e - n) : 4 * e] + tail
                for k, at in enumerate(range(0, n + 1, capacity)):
                    part = own[4 * at : 4 * (at + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_ = 0  # bit r: some bin has r free places
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += n
        if room > n:
            free[room - n].append(b)
            open_ |= 1 << (room - n)
    return where, offset, np.array(fills, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound that dual feasible functions give; counts[s]: items of size s, 0 to capacity."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    mass, items = np.cumsum(counts * sizes), np.cumsum(counts)
    # threshold t: sizes above capacity - t count as whole sequences, sizes below t as nothing
    t = np.arange(0, capacity // 2 + 1)
    whole = items[-1] - items[capacity - t]
    middle = mass[capacity - t] - np.where(t > 0, mass[np.maximum(t, 1) - 1], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 33):  # rounding down to multiples of 1 / k where (k + 1) * size isn't a multiple of the capacity
        exact = (k + 1) * sizes % capacity == 0
        value = np.where(exact, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def _pack_part(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ascending=[False, True, True, True], ignore_index=True)
    lengths = frame["length"].to_numpy()
    where, offset, fills = best_fit(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    return frame.assign(bin=where, offset=offset, fill=fills[where], part_bins=len(fills), part_bound=bound)


def _pack(items: DataFrame, round_: int, parts: int, capacity: int) -> DataFrame:
    """Deals the items anew and packs each partition."""
    # repeated rows differ by nothing but chance; a random-free hash of all columns and of the row's number deals them
    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.lit(round_), "doc_id", "piece", "ids_crc32", "item"), F.lit(parts)))
    columns = [c.split()[0] for c in PACKED.split(", ")]
    return dealt.groupBy("part").applyInPandas(lambda f: _pack_part(f, capacity).assign(round=round_)[[*columns, "item"]], f"{PACKED}, item long")


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Places every piece; returns the placed pieces and a row per final partition with its bins and bound."""
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "pieces")
    sequence = (F.col("round") * F.lit(1 << 54) + F.col("part") * F.lit(1 << 24) + F.col("bin")).cast("long")
    whole = items.where(F.col("length") == capacity).select(*[c.split()[0] for c in PIECES.split(", ")], (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.where(F.col("length") < capacity)
    n = left.count()
    done, round_, parts = [], 0, max(1, -(-n // part_items))
    placed = stored(_pack(left, round_, parts, capacity), "packed")
    while True:
        gap = F.col("part_bins") > F.col("part_bound")
        loose = placed.where(gap & (F.col("fill") < capacity))
        spent = loose.agg(F.count("*").alias("n"), F.countDistinct("part", "bin").alias("bins"), F.countDistinct("part").alias("parts")).first()
        if spent["n"] == 0 or (spent["parts"] == 1 and parts == 1):
            break
        parts_now = max(1, -(-spent["n"] // part_items))
        again = stored(_pack(loose.select(*[c.split()[0] for c in PIECES.split(", ")], "item"), round_ + 1, parts_now, capacity), "packed")
        bins = again.agg(F.countDistinct("part", "bin").alias("bins")).first()["bins"]
        if bins >= spent["bins"]:
            break
        done.append(placed.where(~(gap & (F.col("fill") < capacity))))
        round_, parts, placed = round_ + 1, parts_now, again
    done.append(placed)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    report = out.groupBy("round", "part").agg(F.countDistinct("bin").alias("bins"), F.first("part_bins").alias("packed_bins"), F.first("part_bound").alias("bound"))
    packed = out.select(*[c.split()[0] for c in PIECES.split(", ")], sequence.alias("sequence_id"), "offset")
    return whole.unionByName(packed), report


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(read_table(spark, sf_dir, "documents")))[0]
