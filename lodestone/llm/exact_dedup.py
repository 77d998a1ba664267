"""Exact deduplication by a log-structured merge index (DataFrame functions only).

A batch's splits are memtables: each task sorts its rows' digests and flushes
them as one sorted run file (level 0).  Compaction merges all run files of a
level's batches into one run of the next level, dealt by ranges of the digest
and sorted: per digest the smallest (or largest) identifier and the number of
rows.  FANOUT runs of one level become one run of the next, so that n batches
make about log(n) levels.

Every run has a filter: a table of bitmaps, one bit for each digest's short
hash.  A lookup tests rows against the filters, before they are shuffled; only
rows that pass are joined with the runs, and a hit is a duplicate only when its
bytes are verified.  The filter of the digests that occur more than once serves
the deduplication of a table itself: texts of all other rows never move.

A filter is broadcast up to filters.BROADCAST_BITMAPS bitmaps (32 MB).  It is never
larger for the repeated digests: beyond that its bits are shared, so that more
rows than needed are shuffled, but no result changes.

Defined cases: a null text counts as empty, and all empty texts are equal;
texts are equal when identical after lower-casing A-Z only.  A null identifier
ranks below all others.  Rows repeated with identifier and text stay repeated
in the result; one of them at most is kept.  An empty table gives no rows.
Texts of any length are hashed and compared whole.  Other columns, whatever
their names, are passed through by `keep_distinct` and left out elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters
from .common import ascii_lower, doc_columns, fresh_path, quoted, read_table, stored
from .filters import bitmaps_for, make_filter, passing

#: Rows of one group that are joined together; larger groups are salted.
SALT_ROWS = 2_000
#: Runs of one level that are merged into one of the next.
FANOUT = 4

_RUN = "digest binary, short long, keep_id long, n_rows long"


def digest(normalised: Column) -> Column:
    return F.sha2(F.encode(normalised, "UTF-8"), 256)


def short_hash(normalised: Column) -> Column:
    """What filters know of a text; texts of equal digests that differ in it are different."""
    return F.xxhash64(normalised)


def _best(keep: str):
    return F.min if keep == "min" else F.max


class MergeIndex:
    """Runs of digests in a folder of the shared store; keep: which identifier of equal texts stays ("min" or "max")."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min"):
        self.spark, self.path, self.keep = spark, path or fresh_path(spark, "index"), keep
        self.runs: list[dict] = []  # a few entries a level: level, path, filter, bitmaps
        self._made = 0

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flushes a batch's memtables (one sorted run file a task), compacts them, and merges levels that are full."""
        text = F.col("text")
        rows = doc_columns(docs, id_col, text_col).select(ascii_lower(text).alias("text"), "doc_id")
        rows = rows.select(F.unhex(digest(text)).alias("digest"), short_hash(text).alias("short"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n_rows"))
        flushed = self._path("flushed")
        rows.sortWithinPartitions("digest", "short").write.parquet(flushed)
        self._merge([flushed], 1)
        level = 1
        while len(full := [r for r in self.runs if r["level"] == level]) >= FANOUT:
            self.runs = [r for r in self.runs if r["level"] != level]
            self._merge([r["path"] for r in full], level + 1)
            level += 1

    def _path(self, tag: str) -> str:
        self._made += 1
        return f"{self.path}/{tag}-{self._made}"

    def _merge(self, paths: list[str], level: int) -> None:
        """Merges sorted runs into one; ranges of digests are dealt evenly, as digests are."""
        merged = self._grouped(self.spark.read.schema(_RUN).parquet(*paths))
        run, filter_ = self._path(f"level{level}"), self._path("filter")
        merged.sortWithinPartitions("digest", "short").write.parquet(run)
        written = self.spark.read.schema(_RUN).parquet(run)
        bitmaps = bitmaps_for(written.count())
        make_filter(written, bitmaps).write.parquet(filter_)
        self.runs.append({"level": level, "path": run, "filter": filter_, "bitmaps": bitmaps})

    def _grouped(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest", "short").agg(_best(self.keep)("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))

    def merged(self) -> DataFrame:
        """digest, short, keep_id, n_rows over all runs."""
        if not self.runs:
            return self.spark.createDataFrame([], _RUN)
        rows = self.spark.read.schema(_RUN).parquet(*[r["path"] for r in self.runs])
        return rows if len(self.runs) == 1 else self._grouped(rows)

    def lookup(self, batch: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The batch's rows whose text the index holds: doc_id, keep_id; corpus: the documents that were added.

        Rows pass a run's filter before they are joined with the runs; only the
        texts of kept documents that were met are read from the corpus.
        """
        text = F.col("text")
        rows = doc_columns(batch, id_col, text_col).select("doc_id", ascii_lower(text).alias("text")).withColumn("short", short_hash(text))
        likely = None
        for run in self.runs:
            some = passing(rows, self.spark.read.parquet(run["filter"]), run["bitmaps"])
            likely = some if likely is None else likely.unionByName(some)
        if likely is None:
            return self.spark.createDataFrame([], "doc_id long, keep_id long")
        # a row may pass several filters; equal rows of a batch are counted
        likely = likely.groupBy("doc_id", "text", "short").agg(F.lit(1).alias("one")).withColumn("digest", F.unhex(digest(text)))
        met = stored(likely.join(self.merged().select("digest", "short", "keep_id"), ["digest", "short"]), "met")
        wanted = met.select("short").distinct()
        bitmaps = bitmaps_for(wanted.count(), filters.BROADCAST_BITMAPS)
        old = doc_columns(corpus, id_col, text_col).select(F.col("doc_id").alias("keep_id"), ascii_lower(text).alias("text")).withColumn("short", short_hash(text))
        old = passing(old, stored(make_filter(wanted, bitmaps), "filter"), bitmaps).select("keep_id", "text").distinct().select(F.col("keep_id").alias("old_id"), F.col("text").alias("old_text"))
        return met.join(old, F.col("keep_id").eqNullSafe(F.col("old_id")) & (F.col("text") == F.col("old_text")), "left_semi").select("doc_id", "keep_id")


def _repeated(index: MergeIndex) -> tuple[DataFrame, DataFrame, int]:
    """The digests that occur more than once, their filter and its bitmaps."""
    groups = stored(index.merged().where("n_rows > 1"), "groups")
    bitmaps = bitmaps_for(groups.count(), filters.BROADCAST_BITMAPS)
    return groups, stored(make_filter(groups, bitmaps), "filter"), bitmaps


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = MergeIndex(docs.sparkSession, keep=keep)
    index.add(docs, id_col, text_col)
    groups, filter_, bitmaps = _repeated(index)

    # A digest seen once is its own group.  Of the others the rows are hits, and their bytes are verified.
    single = index.merged().where("n_rows = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    text = F.col("text")
    rows = doc_columns(docs, id_col, text_col).select("doc_id", ascii_lower(text).alias("text")).withColumn("short", short_hash(text))
    likely = passing(rows, filter_, bitmaps).withColumn("digest", F.unhex(digest(text)))
    salted = groups.select("digest", "short", F.ceil(F.col("n_rows") / SALT_ROWS).cast("int").alias("salts"))
    hits = stored(likely.join(salted, ["digest", "short"]), "hits")

    # Verification: rows are one group when all their bytes are equal, whatever their digests.  Tasks sum up first.
    totals = stored(hits.groupBy("digest", "short", "salts", "text").agg(_best(keep)("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "totals")
    apart = totals.groupBy("digest", "short").agg(F.count("*").alias("texts")).where("texts > 1").select("digest", "short", F.lit(True).alias("apart"))
    # the text takes part in the join only where a digest has several: as a rule nowhere
    if apart.isEmpty():
        told = F.lit(None).cast("string")
    else:
        hits, totals = (x.join(apart, ["digest", "short"], "left") for x in (hits, totals))
        told = F.when(F.col("apart"), text)
    sizes = hits.groupBy("digest", "short", "salts", "doc_id", told.alias("told")).agg(F.count("*").alias("n"))
    left = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    right = totals.select(F.col("digest").alias("other_digest"), F.col("short").alias("other_short"), told.alias("other"), "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other_salt"))
    match = (F.col("digest") == F.col("other_digest")) & (F.col("short") == F.col("other_short")) & (F.col("salt") == F.col("other_salt")) & F.col("told").eqNullSafe(F.col("other"))
    found = left.join(right, match)
    shared = found.select("doc_id", "keep_id", "group_size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    shared = shared.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")
    return single.unionByName(shared).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    A document that doesn't pass the filter of repeated digests stays where it
    is; of the others one of each text stays, picked by the bytes themselves.
    """
    index = MergeIndex(docs.sparkSession, keep=keep)
    index.add(docs, id_col, text_col)
    _, filter_, bitmaps = _repeated(index)
    row = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"), quoted(id_col).cast("long").alias("id"), ascii_lower(quoted(text_col)).alias("text"))
    row = row.withColumn("short", short_hash(F.col("text")))
    alone = passing(row, filter_, bitmaps, found=False).select("doc")
    # null identifiers rank below all others either way
    rank = F.struct(F.col("id").isNotNull() if keep == "max" else F.col("id").isNull(), "id")
    hits = passing(row, filter_, bitmaps)
    best = hits.groupBy("text").agg((F.max_by if keep == "max" else F.min_by)("doc", rank).alias("doc")).select("doc")
    return alone.unionByName(best).select("doc.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
