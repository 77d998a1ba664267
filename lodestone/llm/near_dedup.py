"""Near-duplicate detection by ProbMinHash, banding and verification.

A document's elements are its distinct runs of five words, all of weight 1.
Each element is a Poisson process whose rate is its weight; its arrivals fall
on the M signature components at random, and a component keeps the element
that arrives first, which estimates the probability Jaccard similarity.  With
equal weights that is the Jaccard similarity of the sets, which links are
judged by, so that repeated parts don't keep a pair out of a bucket.  An element stops as soon as its next arrival
is later than every component's first one.  Bands of ROWS components propose
candidates; a link is a pair whose exact Jaccard similarity of shingle sets is
at least the threshold.

Documents with the same shingles are one node.  In a bucket every node is
verified against one centre, drawn anew per band; a centre's set is held in a
task while the others pass by, and a centre of very many nodes is dealt over
salts.  In buckets where many nodes are outside of the largest component still,
nodes are verified against CENTRES more centres of other components; if many
stay outside, the bucket's nodes are grouped anew by the shingles of their
prefixes (of a set of n shingles, rarest first, the first n - ceil(0.8 n) + 1,
of which similar sets always share one).  What is left is compared exactly, the
nodes outside of a group's largest component with all others: as pairs in small
groups, and in others inside tasks, block against block, which return a spanning
set of links.  So no link that a bucket proposes is lost, and all pairs of a
large group are never made as rows.

Defined cases: a null text counts as empty; a text without words is a class of
its own; a text of one to four words has one shingle, of all its words; words
are compared lower-cased (A-Z), without punctuation; a null or repeated
identifier is kept apart by row, and the class is named by the identifier of
its first row; an empty table gives no rows.  A text of any length is taken
whole (its set of shingles is held by a task at once).  Other columns, whatever
their names, are passed through by `keep_one` and left out by `near_duplicates`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, doc_columns, quoted, read_table, stored, unused
from .filters import near_keys
from .graph import components
from .textbuf import buffers, chunks, mix, powers, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
#: Centres that the nodes of a bucket of several components are verified against in the second look.
CENTRES = 4
#: Nodes of a group whose pairs are made as rows; and nodes outside of its largest component that need no prefixes.
SMALL = 32
#: Nodes of a block of a larger group.
BLOCK = 256
#: Sets that pass by one held set in a task.
SALT_PAIRS = 4096
#: Rows of a batch whose rows hold whole sets.
SET_ROWS = 256
_ELEMENT_BITS = 44


def elements(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in ascending order: hash (44 bits), row, occurrences."""
    hashes, row = shingles(*words(buf, offsets), size)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(offsets) > 1 << (64 - _ELEMENT_BITS):
        raise ValueError("too many rows in one chunk")
    key = np.sort((row.astype(np.uint64) << np.uint64(_ELEMENT_BITS)) | (hashes >> np.uint64(64 - _ELEMENT_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(first, len(key)))
    key = key[first]
    return key & np.uint64((1 << _ELEMENT_BITS) - 1), (key >> np.uint64(_ELEMENT_BITS)).astype(np.int64), many


def signatures(x: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, rows by m (0 where a row has no elements)."""
    first = np.full(rows * m, np.inf)
    winner = np.zeros(rows * m, np.uint64)
    time, active, step = np.zeros(len(x)), np.arange(len(x)), 0
    while len(active):
        step += 1
        draw = mix(x[active] + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        place = mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)
        t = time[active] - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
        time[active] = t
        at = row[active] * m + place.astype(np.int64)
        early = np.flatnonzero(t < first[at])
        np.minimum.at(first, at[early], t[early])
        won = early[t[early] == first[at[early]]]
        winner[at[won]] = x[active[won]]
        latest = first.reshape(rows, m).max(axis=1)
        active = active[t < latest[row[active]]]
    return winner.reshape(rows, m)


def signed(rows: DataFrame, bands: int = BANDS, per_band: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """rid, n (distinct shingles), set1 and set2 (a hash of the set), bands (null without shingles); rows: rid, text."""
    m = bands * per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            for lo, hi in chunks(offsets):
                k = hi - lo
                x, row, _ = elements(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                n = np.bincount(row, minlength=k)
                sig = signatures(x, row, np.ones(len(x)), k, m)
                key = np.zeros((k, bands), np.uint64)
                for j in range(per_band):
                    key += sig[:, j::per_band][:, :bands] * powers(per_band + 1)[j + 1]
                key = mix(key).view(np.int64)
                sums = [np.zeros(k, np.uint64), np.zeros(k, np.uint64)]
                for salt, out in enumerate(sums):
                    np.add.at(out, row, mix(x + np.uint64(salt * 0x5851F42D4C957F2D + 1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * bands, pa.int32()), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(lo, k), pa.array(n, pa.int64()), *[pa.array(s.view(np.int64)) for s in sums], lists], names=["rid", "n", "set1", "set2", "bands"])

    return rows.mapInArrow(run, "rid long, n long, set1 long, set2 long, bands array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            for lo, hi in chunks(offsets):
                x, row, _ = elements(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(lo, hi - lo), pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["rid", "elements"])

    return rows.mapInArrow(run, "rid long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold; pairs: held, other, salt; sets: rid, elements.

    A set is sent once for each (held, salt) and each other, not once for each pair and side.
    """
    held = pairs.select("held", "salt").distinct().join(sets, F.col("held") == F.col("rid")).select("held", "salt", F.lit(0).cast("long").alias("side"), "held", "elements")
    others = pairs.join(sets, F.col("other") == F.col("rid")).select("held", "salt", F.lit(1).cast("long").alias("side"), "other", "elements")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.toDF("held", "salt", "side", "node", "elements").unionByName(others.toDF("held", "salt", "side", "node", "elements"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("held", "salt", "side", "node")]
            for h, salt, side, node, e in zip(*columns, batch.column("elements")):
                theirs = np.frombuffer(e.as_buffer(), np.uint64)
                if side == 0:
                    key, mine = (h, salt), theirs.copy()
                    continue
                if key != (h, salt):
                    raise ValueError("a pair without the set that it is compared with")
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                if common >= threshold * (len(mine) + len(theirs) - common):
                    a.append(min(h, node))
                    b.append(max(h, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(tasks, "held", "salt").sortWithinPartitions("held", "salt", "side").mapInArrow(run, "a long, b long")


def _mixed(placed: DataFrame) -> DataFrame:
    """The groups (band, key) of several components: their rows with main (the largest component), members, others (nodes outside of it)."""
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("band", "key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("members")).where("members > top.size")
    tops = stored(tops.select("band", "key", F.col("top.component").alias("main"), "members", (F.col("members") - F.col("top.size")).alias("others")), "mixed")
    return stored(placed.join(tops, ["band", "key"]), "mixed")


def _by_prefix(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Groups of nodes that share a shingle of their prefixes, as `_mixed` gives them; nodes: node, component.

    Two sets of similarity t share one of the first n - ceil(t n) + 1 of their
    elements in any order common to all; with the rarest first few others do.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                part = batch.slice(i, 16)
                own = [np.frombuffer(e.as_buffer(), np.uint64) for e in part.column("elements")]
                n = np.array([len(x) for x in own], np.int64)
                at = pa.array(np.repeat(np.arange(len(part)), n))
                yield pa.RecordBatch.from_arrays([part.column("node").take(at), part.column("component").take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(own).astype(np.int64))], names=["node", "component", "n", "key"])

    rows = stored(nodes.join(sets.withColumnRenamed("rid", "node"), "node").select("node", "component", "elements").mapInArrow(spread, "node long, component long, n long, key long"), "elements")
    often = stored(rows.groupBy("key").agg(F.count("*").alias("often")), "often")
    rarest = W.partitionBy("node").orderBy("often", "key")
    first = rows.join(often, "key").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (threshold - 1e-9)) + 1)
    return _mixed(stored(first.select(F.lit(-1).alias("band"), "key", "node", "n", "component"), "prefixes"))


def _outer_pairs(groups: DataFrame, near) -> DataFrame:
    """a, b, held, other, salt: each node outside of its group's largest component with all of other components."""
    outer = groups.where("component <> main").select("band", "key", F.col("node").alias("held"), F.col("n").alias("held_n"), F.col("component").alias("held_component"))
    both = groups.join(outer, ["band", "key"]).where((F.col("component") != F.col("held_component")) & near(F.col("n"), F.col("held_n")))
    pair = F.struct("held", F.col("node").alias("other"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / SALT_PAIRS)).cast("int").alias("salt"))
    return both.select(F.least("held", "node").alias("a"), F.greatest("held", "node").alias("b"), pair.alias("pair"))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.min("pair").alias("pair")).select("a", "b", "pair.*")


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the similarity; common elements are counted by products of 0-1 tables."""
    sizes = [np.array([len(x) for x in side], np.float32) for side in (left, right)]
    known, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)])
    cut = int(sizes[0].sum())
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(known), 8192):
        tables = []
        for side, span in ((left, slice(0, cut)), (right, slice(cut, None))):
            inside = (code[span] >= low) & (code[span] < low + 8192)
            table = np.zeros((len(side), min(8192, len(known) - low)), np.float32)
            table[rows[span][inside], code[span][inside] - low] = 1
            tables.append(table)
        common += tables[0] @ tables[1].T
    return common >= np.float32(threshold - 1e-6) * (sizes[0][:, None] + sizes[1][None, :] - common)


def _blocks_compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join components, of sorted rows: band, key, i, j, side, node, component, elements."""

    def links(rows: list[dict]) -> Iterator[tuple[int, int]]:
        left, right = ([r for r in rows if r["side"] == k] for k in (0, 1))
        if not left or not right:
            return
        sets = [[np.frombuffer(r["elements"], np.uint64) for r in side] for side in (left, right)]
        ids, parts = ([np.array([r[c] for r in side]) for side in (left, right)] for c in ("node", "component"))
        mask = similar(*sets, threshold) & (parts[0][:, None] != parts[1][None, :])
        p, q = np.nonzero(mask)
        a, b = ids[0].copy(), ids[1].copy()
        while True:  # the smallest node that is reachable inside the two blocks
            a2, b2 = a.copy(), b.copy()
            np.minimum.at(a2, p, b[q])
            np.minimum.at(b2, q, a2[p])
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
        for side, root in ((0, a), (1, b)):
            for i in np.flatnonzero(root != ids[side]):
                yield int(ids[side][i]), int(root[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = ("band", "key", "i", "j"), []

        def flush() -> pa.RecordBatch:
            found = list(zip(*links(held))) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

        for batch in batches:
            for lo in range(0, len(batch), 64):
                for row in batch.slice(lo, 64).to_pylist():
                    if held and any(held[0][k] != row[k] for k in key):
                        yield flush()
                        held = []
                    held.append(row)
        if held:
            yield flush()

    return blocks.mapInArrow(run, "a long, b long")


def with_row_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """rid, doc_id, text; whether rid is doc_id itself (it is where identifiers are unique and not null)."""
    rows = doc_columns(docs, id_col, text_col)
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text"), True
    ordered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return stored(ordered, "rows"), False  # numbers must not change when a task is run again


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, per_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, kept."""
    rows, unique = with_row_ids(docs, id_col, text_col)
    return _classes(rows, unique, threshold, size, bands, per_band).select("doc_id", "class_id", "kept")


def _classes(rows: DataFrame, unique: bool, threshold: float, size: int, bands: int, per_band: int) -> DataFrame:
    sigs = stored(signed(rows.select("rid", "text"), bands, per_band, size), "signatures")
    nodes = stored(sigs.where("n > 0").groupBy("set1", "set2", "n").agg(F.min("rid").alias("node"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    centre = F.min(F.struct(F.xxhash64("node", "band").alias("draw"), F.col("node").alias("centre"), F.col("n").alias("centre_n")))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("members"), centre.alias("c")).where("members > 1")
    members = stored(banded.join(buckets, ["band", "key"]).select("band", "key", "members", "node", "n", "c.centre", "c.centre_n"), "members")

    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * threshold  # noqa: E731  sizes that allow the similarity
    salts = F.ceil(F.col("members") / SALT_PAIRS).cast("int")
    drawn = members.where((F.col("node") != F.col("centre")) & near(F.col("n"), F.col("centre_n"))).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), F.struct(F.col("centre").alias("held"), F.col("node").alias("other"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt")).alias("pair"))
    pairs = stored(_distinct_pairs(drawn), "pairs")
    # the sets of all nodes that share a bucket, from one shuffle of their texts
    chosen = stored(members.select(F.col("node").alias("rid")).distinct(), "chosen")
    sets = stored(_sets(near_keys(rows.select("rid", "text"), chosen, "rid").join(chosen.hint("merge"), "rid", "left_semi"), size), "sets")
    with arrow_rows(rows.sparkSession, SET_ROWS):
        links = stored(verified(pairs, sets, threshold), "links")
    found = components(links)

    def placed() -> DataFrame:
        mine = found.withColumnRenamed("node", "member")
        return members.join(mine, F.col("node") == F.col("member"), "left").select("band", "key", "node", "n", F.coalesce("component", "node").alias("component"))

    def linked(asked: DataFrame) -> list[DataFrame]:
        """The links among pairs that weren't asked for at first, if there are any."""
        fresh = stored(_distinct_pairs(asked).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            return []
        with arrow_rows(rows.sparkSession, SET_ROWS):
            more = stored(verified(fresh, sets, threshold), "links")
        return [] if more.isEmpty() else [more]

    # a second look at large buckets of several components: most of their nodes have a partner near one of a few more centres
    mixed = _mixed(placed())
    many = mixed.where(F.col("others") > SMALL)
    if not many.isEmpty():
        drawn = [F.min(F.struct(F.xxhash64("node", "band", F.lit(k)).alias("draw"), "node", "n", "component")) for k in range(CENTRES)]
        centres = many.groupBy("band", "key").agg(F.array(*drawn).alias("centres")).select("band", "key", F.explode("centres").alias("c"))
        both = many.join(stored(centres.select("band", "key", "c.*").toDF("band", "key", "draw", "held", "held_n", "held_component").distinct(), "centres"), ["band", "key"])
        both = both.where((F.col("component") != F.col("held_component")) & near(F.col("n"), F.col("held_n")))
        pair = F.struct("held", F.col("node").alias("other"), F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / SALT_PAIRS)).cast("int").alias("salt"))
        for more in linked(both.select(F.least("held", "node").alias("a"), F.greatest("held", "node").alias("b"), pair.alias("pair"))):
            links = links.unionByName(more)
            found = components(links)
            mixed = _mixed(placed())
    if not mixed.isEmpty():
        few, many = mixed.where(F.col("members") <= SMALL), mixed.where(F.col("members") > SMALL)
        vast = many.where(F.col("others") > SMALL)
        if not vast.isEmpty():
            grouped = _by_prefix(vast.select("node", "component").distinct(), sets, threshold)
            few = few.unionByName(grouped.where(F.col("members") <= SMALL))
            many = many.where(F.col("others") <= SMALL).unionByName(grouped.where(F.col("members") > SMALL))
        more = linked(_outer_pairs(few, near))
        if not many.isEmpty():
            outer_blocks, blocks_ = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("others", "members"))
            number = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
            left = many.where("component <> main").withColumn("i", number(outer_blocks)).withColumn("j", every(blocks_)).withColumn("side", F.lit(0))
            right = many.withColumn("j", number(blocks_)).withColumn("i", every(outer_blocks)).withColumn("side", F.lit(1))
            order = ["band", "key", "i", "j"]
            tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            columns = [*order, "side", "node", "component"]
            dealt = left.select(*columns).unionByName(right.select(*columns)).join(sets.withColumnRenamed("rid", "node"), "node")
            blocks = dealt.select(*columns, "elements").repartition(tasks, *order).sortWithinPartitions(*order, "side")
            with arrow_rows(rows.sparkSession, SET_ROWS):
                more.append(stored(_blocks_compared(blocks, threshold), "links"))
        if more:
            found = components(functools.reduce(DataFrame.unionByName, more, links))

    named = nodes.select("set1", "set2", "n", "node").join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("set1", "set2", "n", F.coalesce("component", "node").alias("class_rid"))
    judged = sigs.where("n > 0").join(named, ["set1", "set2", "n"]).select("rid", "class_rid").unionByName(sigs.where("n = 0").select("rid", F.col("rid").alias("class_rid")))
    judged = judged.withColumn("kept", F.col("rid") == F.col("class_rid"))
    if unique:
        return judged.select("rid", F.col("rid").alias("doc_id"), F.col("class_rid").alias("class_id"), "kept")
    names = rows.select("rid", "doc_id")
    return judged.join(names, "rid").join(names.select(F.col("rid").alias("class_rid"), F.col("doc_id").alias("class_id")), "class_rid").select("rid", "doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, per_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    rows, unique = with_row_ids(docs, id_col, text_col)
    mine = unused(docs.columns, "rid")[0]
    if unique:
        whole = docs.withColumn(mine, quoted(id_col).cast("long"))
    else:
        whole = stored(docs.withColumn(mine, F.monotonically_increasing_id()), "rows")
        rows = whole.select(F.col(mine).alias("rid"), quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    kept = _classes(rows, unique, threshold, size, bands, per_band).where("kept").select(F.col("rid").alias(mine))
    return whole.join(kept, mine, "left_semi").select(*[quoted(c) for c in docs.columns])


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
