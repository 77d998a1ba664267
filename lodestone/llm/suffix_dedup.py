"""Repeated passages by a sparse suffix array.

Of all suffixes only those at content-selected positions are kept: the
minimisers, the smallest hash of GRAM words in every window of WINDOW such
hashes.  Any run of GRAM + WINDOW - 1 words that two documents share has one of
its minimisers in both.  Suffixes whose first GRAM words occur in no other
document go first, on hashes alone.  The others are sorted by their words,
neighbours of different documents are compared, and each match is extended to
the right and to the left.  Matches of at least MIN_WORDS words are merged per
document.

Sorted neighbours don't show every match: a document may share its left words
with another row of the same key than the one it shares most right words with.
So the windows of MIN_WORDS words around each kept position are hashed and
grouped, and every window that two documents hold is a match.  Left out are
those that the sort rules out or has found already (`_neighbours`).

Only suffixes with the same first words (key) are ever compared, so that the
suffixes are dealt by key and sorted inside partitions.  A key of more than
HOT_ROWS suffixes is sorted over range partitions instead; there the edges of
neighbouring partitions (a document's run of suffixes and one more row at
either end) are compared in a second small step, so that no suffix misses a
neighbour.

Words are compared by 32 bits of their hashes, 50 in a row: that a span is
false, or a word too long, has a chance of 2**-32 for each word at its end.

Defined cases: words are compared lower-cased (A-Z), without punctuation; null,
empty and short texts have no spans; a passage repeated only inside one
document isn't a span; rows with a null or repeated identifier are documents of
their own, reported under that identifier; an empty table gives no rows.  A text
of any length is taken whole; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, stored
from .filters import near_keys
from .near_dedup import with_row_ids
from .textbuf import buffers, chunks, mix, powers, shingles, words

MIN_WORDS = 50
GRAM = 16
WINDOW = MIN_WORDS - GRAM + 1
#: Words kept to the left and to the right of a position: what a match of MIN_WORDS can need, and more comes from the next position.
LEFT, RIGHT = WINDOW, MIN_WORDS

#: Suffixes of a key up to which one task sorts them.
HOT_ROWS = 5_000

_SUFFIX = "key long, right binary, left binary, rid long, pos long, n_left int, n_right int"


def minimisers(hashes: np.ndarray, counts: np.ndarray, least: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions of all rows with at least `least` words: row, position in the row, hash of `gram` words."""
    window = least - gram + 1
    enough = counts >= least
    if not enough.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows = np.flatnonzero(enough)
    hashes = hashes[np.repeat(enough, counts)]
    counts = counts[rows]
    keys, row = shingles(hashes, counts, gram)
    begins = np.cumsum(counts - gram + 1) - (counts - gram + 1)
    at = np.arange(len(keys)) - begins[row]
    inside = np.flatnonzero(at + window <= (counts - gram + 1)[row])
    best = inside + np.lib.stride_tricks.sliding_window_view(keys, window)[inside].argmin(1)
    best = np.unique(best)
    return rows[row[best]], at[best], keys[best]


def positions(rows: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """rid, pos, key of every kept suffix; rows: rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            for lo, hi in chunks(offsets):
                row, at, key = minimisers(*words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), least, gram)
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row + lo)), pa.array(at), pa.array(key.view(np.int64))], names=["rid", "pos", "key"])

    return rows.mapInArrow(run, "rid long, pos long, key long")


def _suffixes(rows: DataFrame, gram: int) -> DataFrame:
    """The words around each kept position; rows: rid, text, places (positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            places = batch.column("places")
            for lo, hi in chunks(offsets):
                hashes, counts = words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                begin = np.cumsum(counts) - counts
                own = places.slice(lo, hi - lo)
                many = np.array([len(x) for x in own], np.int64)
                pos = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(hi - lo), many)
                at, n = begin[row] + pos, counts[row]
                n_left, n_right = np.minimum(pos, LEFT), np.minimum(n - pos, RIGHT)
                padded = np.concatenate([np.zeros(LEFT, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32), np.zeros(RIGHT, np.uint32)])
                right = padded[LEFT + at[:, None] + np.arange(RIGHT)]
                right[np.arange(RIGHT) >= n_right[:, None]] = 0
                left = padded[LEFT - 1 + at[:, None] - np.arange(LEFT)]
                left[np.arange(LEFT) >= n_left[:, None]] = 0
                key, key_row = shingles(hashes, counts, gram)
                first = np.searchsorted(key_row, np.arange(hi - lo))
                key = key[first[row] + pos]
                columns = [pa.array(key.view(np.int64)), _binary(right.astype(">u4")), _binary(left), batch.column("rid").slice(lo, hi - lo).take(pa.array(row)), pa.array(pos), pa.array(n_left.astype(np.int32)), pa.array(n_right.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SUFFIX.split(", ")])

    return rows.mapInArrow(run, _SUFFIX)


def _binary(table: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    table = np.ascontiguousarray(table)
    width = table.shape[1] * table.itemsize
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(np.arange(len(table) + 1, dtype=np.int32) * width), pa.py_buffer(table.tobytes())])


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


class _Rows:
    """Sorted suffixes as numpy tables."""

    def __init__(self, batch: pa.RecordBatch):
        self.key, self.rid, self.pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rid", "pos"))
        self.n_left, self.n_right = batch.column("n_left").to_numpy(), batch.column("n_right").to_numpy()
        self.right = buffers(batch.column("right"))[0].reshape(-1, RIGHT * 4).view(np.uint32)
        self.left = buffers(batch.column("left"))[0].reshape(-1, LEFT * 4).view(np.uint32)


def _windows(t: _Rows, rows: np.ndarray, shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, rid, start of the windows of `least` words that hold the rows' keys and at most `shared` words from there on."""
    n = LEFT + RIGHT
    inverse = np.full(n, pow(int(powers(2)[1]), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    low, high = np.maximum(least - shared, 0), np.minimum(t.n_left[rows], least - GRAM)
    some = low <= high
    rows, low, high = rows[some], low[some], high[some]
    line = np.concatenate([t.left[rows, ::-1], t.right[rows].byteswap()], axis=1).astype(np.uint64) * powers(n)
    sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(line, axis=1, dtype=np.uint64)], axis=1)
    many = (high - low + 1).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), many)
    left = low[at] + np.arange(len(at)) - (np.cumsum(many) - many)[at]
    begin = LEFT - left
    return mix((sums[at, begin + least] - sums[at, begin]) * inverse[begin]).view(np.int64), t.rid[rows[at]], t.pos[rows[at]] - left


def _neighbours(batch: pa.RecordBatch, least: int, inner: slice) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Spans that neighbouring documents share: rid, start, end, other; and windows of the rows `inner`: hash, rid, start.

    No document shares more words to the right than a sorted neighbour, so that
    longer right sides need no hash (at the ends of the batch nothing is known).
    Of equal rows two documents' are enough, as the others are neighbours of one.
    Nor need the two rows of a key that has no more.
    """
    t = _Rows(batch)
    n = len(t.rid)
    turn = np.flatnonzero((t.rid[1:] != t.rid[:-1]) | (t.key[1:] != t.key[:-1])) + 1  # runs of one document
    begin = np.concatenate([[0], turn])
    end = np.append(turn, n)
    run = np.repeat(np.arange(len(begin)), end - begin)
    before, after = begin[run] - 1, end[run]
    pairs = []
    for other in (before, after):
        mine = np.flatnonzero((other >= 0) & (other < n))
        theirs = other[mine]
        ok = (t.key[mine] == t.key[theirs]) & (t.rid[mine] != t.rid[theirs])
        pairs.append(np.stack([mine[ok], theirs[ok]]))
    p, q = np.concatenate(pairs, axis=1)
    r = np.minimum(_same(t.right[p], t.right[q]), np.minimum(t.n_right[p], t.n_right[q]))
    l_ = np.minimum(_same(t.left[p], t.left[q]), np.minimum(t.n_left[p], t.n_left[q]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, p, r)
    known = (run > 0) & (run < len(begin) - 1)
    most = np.where(known, most, t.n_right)
    fresh = np.flatnonzero(np.concatenate([[True], t.key[1:] != t.key[:-1]]))
    rows_of_key = np.repeat(np.diff(np.append(fresh, n)), np.diff(np.append(fresh, n)))
    inside = (t.key != t.key[0]) & (t.key != t.key[-1])
    equal = np.concatenate([[False], (t.key[1:] == t.key[:-1]) & (t.n_left[1:] == t.n_left[:-1]) & (t.n_right[1:] == t.n_right[:-1]) & (t.right[1:] == t.right[:-1]).all(1) & (t.left[1:] == t.left[:-1]).all(1)])
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(n)))  # the first of equal rows; they are in order of rid
    other = t.rid != t.rid[head]
    second = other & ~np.concatenate([[False], other[:-1]])
    several = np.zeros(n, bool)
    several[head[other]] = True
    needed = ~several[head] | (head == np.arange(n)) | second
    needed &= ~(inside & (rows_of_key == 2))
    rows = np.arange(n)[inner]
    rows = rows[needed[inner]]
    windows = pa.RecordBatch.from_arrays([pa.array(c) for c in _windows(t, rows, most[rows], least)], names=["hash", "rid", "start"])
    ok = r + l_ >= least
    p, q, r, l_ = p[ok], q[ok], r[ok], l_[ok]
    rid, at, other = np.concatenate([t.rid[p], t.rid[q]]), np.concatenate([t.pos[p], t.pos[q]]), np.concatenate([t.rid[q], t.rid[p]])
    l2, r2 = np.concatenate([l_, l_]), np.concatenate([r, r])
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at - l2), pa.array(at + r2), pa.array(other)], names=["rid", "start", "end", "other"]), windows


def _compared(ordered: DataFrame, least: int) -> DataFrame:
    """Shared spans, windows (with a hash), and the partition's edges (where start is null): the first and the last document's run, each with the row next to it."""
    names = [c.split()[0] for c in _SUFFIX.split(", ")]

    def apart(batch: pa.RecordBatch, row: int) -> np.ndarray:
        """The rows that aren't of the document and key of one row."""
        rid, key = batch.column("rid").to_numpy(), batch.column("key").to_numpy()
        return np.flatnonzero((rid != rid[row]) | (key != key[row]))

    def edge(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.StructArray.from_arrays(rows.columns, names=names)], names=["start", "end", "other", "hash", "edge"])

    def made(found: pa.RecordBatch, kinds: list[pa.DataType]) -> pa.RecordBatch:
        empty, none = [pa.nulls(len(found), k) for k in kinds], pa.nulls(len(found), pa.int64())
        empty[names.index("rid")] = found.column("rid")
        columns = [found.column(c) if c in found.schema.names else none for c in ("start", "end", "other", "hash")]
        return pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(empty, names=names)], names=["start", "end", "other", "hash", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, done = None, False, 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not begun and len(others := apart(batch, 0)):
                yield edge(batch.slice(0, int(others[0]) + 1))
                begun = True
            # the last document's run and the suffix before it go on to the next batch
            others = apart(batch, -1)
            for found in _neighbours(batch, least, slice(done, int(others[-1]) + 1 if len(others) else 0)):
                yield made(found, batch.schema.types)
            done = 1 if len(others) else 0
            held = batch.slice(int(others[-1]) if len(others) else 0)
        if held is not None:
            yield made(_neighbours(held, least, slice(done, None))[1], held.schema.types)
            yield edge(held)

    return ordered.mapInArrow(run, f"start long, end long, other long, hash long, edge struct<{', '.join(c.replace(' ', ':') for c in _SUFFIX.split(', '))}>")


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per merged span: doc_id, start_word, end_word (behind the last), n_words, other_doc_id (a document that shares a part)."""
    spark = docs.sparkSession
    rows, unique = with_row_ids(docs, id_col, text_col)
    kept = stored(positions(rows.select("rid", "text"), least), "suffixes")
    # written, so that both sides of the join are dealt by it alone: a key of very many positions can then be split
    shared = stored(kept.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "keys")
    # a document's positions are bounded by its own length
    places = kept.join(shared.select("key"), "key", "left_semi").groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    places = stored(places, "places")
    suffixes = stored(_suffixes(near_keys(rows.select("rid", "text"), places.select("rid"), "rid").join(places, "rid"), GRAM), "suffixes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in _SUFFIX.split(", ")]
    order = ["key", "right", "left", "rid", "pos"]
    span = lambda df: df.where("start is not null and hash is null").select(F.col("edge.rid").alias("rid"), "start", "end", "other")
    hot = shared.where(F.col("n") > HOT_ROWS).select("key")  # one for each HOT_ROWS suffixes at most
    few = suffixes
    if not hot.isEmpty():
        # broadcast: above a shuffled join the dealing by key is left out as done already, and then its rows may be read locally or split
        few = suffixes.join(F.broadcast(hot), "key", "left_anti")
    found = _compared(few.repartition(parts, "key").sortWithinPartitions(*order).select(*names), least).where("hash is not null or start is not null")
    found = stored(found, "spans")
    spans = span(found)
    if not hot.isEmpty():
        many = stored(suffixes.join(hot, "key", "left_semi"), "hot")
        ranged = stored(_compared(many.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*names), least), "spans")
        edges = ranged.where("start is null and hash is null").select("edge.*").select(*names).distinct()  # a few rows a partition
        between = _compared(edges.repartition(1).sortWithinPartitions(*order), least)
        spans = spans.unionByName(span(ranged)).unionByName(span(between))
        found = found.unionByName(ranged)
    windows = found.where("hash is not null").select("hash", F.col("edge.rid").alias("rid"), "start")
    meets = stored(windows.groupBy("hash").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high"), "meets")
    met = windows.join(meets, "hash").select("rid", "start", (F.col("start") + least).alias("end"), F.when(F.col("rid") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
    every = spans.unionByName(met).distinct()

    line = W.partitionBy("rid").orderBy("start", "end", "other")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    grouped = every.withColumn("fresh", F.when(F.col("start") > reach, 1).otherwise(0)).withColumn("span", F.sum("fresh").over(line.rowsBetween(W.unboundedPreceding, 0)))
    merged = grouped.groupBy("rid", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other"))
    merged = merged.withColumn("n_words", F.col("end_word") - F.col("start_word"))
    if unique:
        return merged.select(F.col("rid").alias("doc_id"), "start_word", "end_word", "n_words", F.col("other").alias("other_doc_id"))
    ids = rows.select("rid", "doc_id")
    return merged.join(ids, "rid").join(ids.select(F.col("rid").alias("other"), F.col("doc_id").alias("other_doc_id")), "other").select("doc_id", "start_word", "end_word", "n_words", "other_doc_id")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents"))
