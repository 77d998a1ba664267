"""Near-duplicate embeddings by an inverted multi-index.

Two independent codebooks, one for each half of the vectors, span a product
grid of cells; every vector is filed under one cell of its label.  A vector
visits cells by the multi-sequence algorithm, nearest first: cells come in the
order of a lower bound of the way from the vector to the cell, and it stops at
the radius within which the target share of partners have their home.  That
radius is measured on the sample that the codebooks are fitted on: on partners
made up at the threshold similarity in random directions, and on the sample's
own pairs; the larger one holds.

A vector is sent to its home and to the cells that it visits, where it is
compared with the residents; a pair that visit each other count in one of the
two cells.  Comparison is exact, in double precision, in blocks of bounded size;
a block returns counts and a spanning set of links, never all its pairs.

The codebooks are fitted on a bounded sample (SAMPLE vectors); every vector is
indexed.  Identical vectors of a label are one node with a multiplicity.  The
MOST_GRIDS commonest vector lengths have a grid each; the vectors of any other
length are one cell of their label, compared whole in blocks.

Defined cases: a vector that is null, empty, zero or has a null or non-finite
component, or whose label is null, links with nothing; vectors of different
length don't link; repeated rows are different vectors that link; a null
identifier ranks below all others as a component's name; an empty table gives
no rows.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, read_table, stored
from .graph import components

THRESHOLD = 0.98
#: Vectors that the codebooks and the radius are fitted on, at most.
SAMPLE = 20_000
TARGET_RECALL = 0.995
#: Vectors of a cell, about, and bounds of a codebook's size.
CELL_VECTORS, LEAST_CODES, MOST_CODES = 32, 4, 2048
#: Vector lengths that have a grid, and vectors that are filed at once.
MOST_GRIDS, FILED_ROWS = 16, 512
#: Vectors of a block's two sides.
LEFT, RIGHT = 1024, 4096


class Grid:
    """Two codebooks and the radius of a visit."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, codes: int, threshold: float, target: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        self.books = [_kmeans(part, codes, rng) for part in self.halves(sample)]
        # partners at exactly the threshold: where are their homes, seen from the vector?
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        partner = threshold * sample + np.sqrt(1 - threshold**2) * noise
        p, q = _sample_pairs(sample, labels, threshold)
        self.radius2 = max((float(np.quantile(self.seen(x, y), target)) for x, y in ((sample, partner), (sample[p], sample[q])) if len(x)), default=0.0)

    def seen(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The squared way from each vector to its partner's home."""
        out = np.zeros(len(x))
        for lo in range(0, len(x), FILED_ROWS):
            part = slice(lo, lo + FILED_ROWS)
            for ways, homes in zip(self.ways(x[part]), self.homes(y[part])):
                out[part] += ways[np.arange(len(homes)), homes] ** 2
        return out

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.cut], x[:, self.cut :]]

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(part, book).argmin(1) for part, book in zip(self.halves(x), self.books)]

    def ways(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half and code: the way to the code's region at least (to the plane between it and the home)."""
        out = []
        for part, book in zip(self.halves(x), self.books):
            d = _distances(part, book)
            home = d.argmin(1)
            between = np.sqrt(np.maximum(_distances(book[home], book), 1e-12))
            out.append(np.maximum(d - d[np.arange(len(d)), home][:, None], 0) / (2 * between))
        return out

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Per vector its home cell and the other cells that it visits, nearest first (multi-sequence algorithm)."""
        k = len(self.books[1])
        ways = [w**2 for w in self.ways(x)]
        orders = [np.argsort(w, axis=1, kind="stable") for w in ways]
        sorted_ = [np.take_along_axis(w, o, 1) for w, o in zip(ways, orders)]
        for a, b, i, j in zip(sorted_[0], sorted_[1], orders[0], orders[1]):
            na, nb = int(np.searchsorted(a, self.radius2, "right")), int(np.searchsorted(b, self.radius2, "right"))
            a, b, i, j = a[:na].tolist(), b[:nb].tolist(), i[:na].tolist(), j[:nb].tolist()
            heap, out = [(a[0] + b[0], 0, 0)], []
            while heap and heap[0][0] <= self.radius2:
                _, p, q = heapq.heappop(heap)
                out.append(i[p] * k + j[q])
                if q + 1 < nb:
                    heapq.heappush(heap, (a[p] + b[q + 1], p, q + 1))
                if q == 0 and p + 1 < na:
                    heapq.heappush(heap, (a[p + 1] + b[0], p + 1, 0))
            yield out[0], out[1:]


def _sample_pairs(x: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The sample's pairs of a label at the threshold, each way round; of a vector with many partners the first 8."""
    p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        for lo in range(0, len(own), 1024):
            mask = x[own[lo : lo + 1024]] @ x[own].T >= threshold
            mask[np.arange(len(mask)), lo + np.arange(len(mask))] = False
            i, j = np.nonzero(mask & (np.cumsum(mask, axis=1) <= 8))
            p.append(own[lo + i])
            q.append(own[j])
    return np.concatenate(p), np.concatenate(q)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * x @ book.T, 0)


def _kmeans(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    book = distinct[rng.permutation(len(distinct))[: max(1, min(codes, len(distinct)))]].copy()
    for _ in range(rounds):
        home = _distances(x, book).argmin(1)
        n = np.bincount(home, minlength=len(book))
        for d in range(x.shape[1]):
            total = np.bincount(home, weights=x[:, d], minlength=len(book))
            book[n > 0, d] = total[n > 0] / n[n > 0]
    return book


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision, from their stored components."""
    wide = np.array([len(r) == 8 * dim for r in raw])
    x = np.empty((len(raw), dim))
    for kind, own in ((np.float64, np.flatnonzero(wide)), (np.float32, np.flatnonzero(~wide))):
        x[own] = np.frombuffer(b"".join(raw[i] for i in own), kind).reshape(len(own), dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stored_components(x: np.ndarray) -> bytes:
    """The bytes of the components: as 32-bit numbers where these are the same, else as 64-bit ones."""
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    return narrow.tobytes() if (narrow == x).all() else x.tobytes()


def _valid(rows: DataFrame) -> DataFrame:
    """rid, label, dim, raw (components) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, label, dim, raw = [], [], [], []
            for r, l, v in zip(batch.column("rid"), batch.column("label"), batch.column("vector")):
                if not l.is_valid or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # no negative zeros
                if np.isfinite(x).all() and x.any():
                    rid.append(r.as_py())
                    label.append(l.as_py())
                    dim.append(len(x))
                    raw.append(stored_components(x))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(label, pa.string()), pa.array(dim, pa.int64()), pa.array(raw, pa.binary())], names=["rid", "label", "dim", "raw"])

    return rows.mapInArrow(run, "rid long, label string, dim long, raw binary")


def _filed(nodes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(grids)  # at most MOST_GRIDS grids of MOST_CODES codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), FILED_ROWS):
                batch = whole.slice(at, FILED_ROWS)
                dims, raw = batch.column("dim").to_pylist(), batch.column("raw").to_pylist()
                home, others = [0] * len(raw), [[]] * len(raw)
                for dim in set(dims) & shared.value.keys():
                    own = [i for i, d in enumerate(dims) if d == dim]
                    for i, (h, o) in zip(own, shared.value[dim].visits(unit_rows([raw[i] for i in own], dim))):
                        home[i], others[i] = h, o
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names=[*batch.schema.names, "cell", "visits"])

    return nodes.mapInArrow(run, "node long, label string, dim long, copies long, raw binary, cell long, visits array<long>")


def _components_in_block(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node reachable inside the block, for both sides."""
    a, b = left.copy(), right.copy()
    p, q = np.nonzero(mask)
    while True:
        a2, b2 = a.copy(), b.copy()
        np.minimum.at(a2, p, b[q])
        np.minimum.at(b2, q, a2[p])
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


_KEY = ("label", "dim", "cell", "chunk", "part")


def _compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """Per block and node with a link: node, n_links, root; blocks: _KEY, side (0: residents), node, copies, raw, home, visits."""

    def block(rows: pa.Table) -> Iterator[tuple]:
        dim, cell = rows.column("dim")[0].as_py(), rows.column("cell")[0].as_py()
        side, node, copies, home = (rows.column(c).to_numpy() for c in ("side", "node", "copies", "home"))
        x = unit_rows(rows.column("raw").to_pylist(), dim)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left):
            return
        sides = []
        if rows.column("part")[0].as_py() == 0:
            mask = x[left] @ x[left].T >= threshold
            np.fill_diagonal(mask, False)
            sides.append((mask, left, False))
        if len(right):
            mask = x[left] @ x[right].T >= threshold
            # a pair that visit each other's cell count in the cell with the smaller number
            p, q = np.nonzero(mask & (home[right] < cell)[None, :])
            if len(p):
                visits = rows.column("visits").take(pa.array(left[p])).to_pylist()
                both = np.array([int(h) in v for v, h in zip(visits, home[right[q]])])
                mask[p[both], q[both]] = False
            sides.append((mask, right, True))
        for mask, other, both in sides:
            if not mask.any():
                continue
            a, b = _components_in_block(mask, node[left], node[other])
            for i in np.flatnonzero(mask.any(1)):
                yield int(node[left[i]]), int((mask[i] * copies[other]).sum()), int(a[i])
            for j in np.flatnonzero(mask.any(0)) if both else ():
                yield int(node[other[j]]), int((mask[:, j] * copies[left]).sum()), int(b[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*block(pa.Table.from_batches(held).combine_chunks()))) or [()] * 3
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n_links", "root"])

        for batch in batches:
            turn = np.zeros(len(batch), bool)
            for k in _KEY:
                column = batch.column(k)
                turn[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(0, len(batch) - 1))).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(turn).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and any(held[0].column(k)[0] != batch.column(k)[lo] for k in _KEY) and hi > lo:
                    yield flush()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    return blocks.mapInArrow(run, "node long, n_links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("vector"), quoted(label_col).cast("string").alias("label"))
    unique = rows.groupBy("vec_id").count().where("count > 1 or vec_id is null").isEmpty()
    rows = rows.withColumn("rid", F.col("vec_id")) if unique else stored(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    valid = stored(_valid(rows.select("rid", "label", "vector")).withColumn("print", F.md5("raw")), "vectors")
    nodes = stored(valid.groupBy("label", "dim", "print").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "nodes")

    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).orderBy(F.desc("n"), "dim").limit(MOST_GRIDS).collect()
    grids = {}
    for s in sizes:
        picked = nodes.where(F.col("dim") == s["dim"]).orderBy(F.xxhash64("node")).limit(SAMPLE).select("raw", F.xxhash64("label").alias("label")).collect()
        codes = int(np.clip(np.sqrt(s["n"] / s["labels"] / CELL_VECTORS), LEAST_CODES, MOST_CODES))
        grids[s["dim"]] = Grid(unit_rows([bytes(p["raw"]) for p in picked], s["dim"]), np.array([p["label"] for p in picked]), codes, threshold, target)
    filed = stored(_filed(nodes.select("node", "label", "dim", "copies", "raw"), grids), "filed")

    place = ["label", "dim", "cell"]
    visitors = filed.select("label", "dim", F.explode("visits").alias("cell"), "node", "copies", "raw", F.col("cell").alias("home"))
    parts = lambda n, most: F.ceil(n / most).cast("int")
    # residents in chunks; what a chunk is compared with (later chunks of its cell and the visitors) in parts
    cells = filed.groupBy(*place).agg(F.count("*").alias("n")).join(visitors.groupBy(*place).agg(F.count("*").alias("m")), place, "left")
    cells = cells.select(*place, parts(F.col("n"), LEFT).alias("chunks"), F.greatest(F.lit(1), parts(F.coalesce("m", F.lit(0)) + F.when(F.col("n") > LEFT, F.col("n")).otherwise(0), RIGHT)).alias("parts"))
    cells = stored(cells, "cells")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    at_home = filed.withColumn("home", F.col("cell")).join(cells, place).withColumn("chunk", chunk)
    left = at_home.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*_KEY, F.lit(0).alias("side"), "node", "copies", "raw", "home", "visits")
    own = at_home.where("chunk > 0").withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)))
    far = visitors.join(cells, place).withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = [x.select(*_KEY, F.lit(1).alias("side"), "node", "copies", "raw", "home", F.lit(None).cast("array<long>").alias("visits")) for x in (own, far)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = left.unionByName(right[0]).unionByName(right[1]).repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, "side", "node")
    found = stored(_compared(blocks, threshold), "links")

    linked = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    described = nodes.select("label", "dim", "print", "node", "copies").join(linked, "node", "left").join(roots, "node", "left")
    described = described.select("label", "dim", "print", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    mine = valid.select("rid", "label", "dim", "print").join(described, ["label", "dim", "print"]).select(F.col("rid").alias("valid_rid"), "n_links", "component")
    out = rows.select("rid", "vec_id").join(mine, F.col("rid") == F.col("valid_rid"), "left").select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rid").alias("component"))
    if unique:
        return out.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    names = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return out.join(names, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
