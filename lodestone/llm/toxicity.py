"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams (3 to 5 bytes of the lower-cased text,
runs of white space as one blank), present or not.  Each feature is scaled by
the logarithm of its smoothed rate in toxic over other training texts; a
regularised logistic regression is trained on the scaled features.  Scoring is
one pass over whole texts in Arrow batches.

The classifier is fitted on a bounded sample of labelled rows: at most
SAMPLE_ROWS of each label, those with the smallest hashes of their identifier,
and at most SAMPLE_FEATURES features of each label (at least one row of each),
in the same order.  Features are taken from whole texts by many tasks; one
task, whose memory SAMPLE_FEATURES and BITS bound (4 and 8 bytes a feature, at
most 800 MB together), fits the weights.  Nothing but the text is an input of a
score.

Defined cases: a null text counts as empty; a text without n-grams gets the
score of the intercept alone; labelled rows with a null label or identifier,
or with two different labels, aren't learned from; without any rows of one of
the labels every score is the share of toxic rows (0 without any labels); an
empty table gives no rows.  A very long text is scored whole, by its distinct
features.  Other columns, whatever their names, are passed through by
`keep_clean` and left out by `toxicity`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, doc_columns, quoted, read_table, stored, unused
from .textbuf import LOWER, buffers

#: Sampled training rows of each label at most.
SAMPLE_ROWS = 3_000
#: Features (distinct slots of texts) of each label's training rows at most.
SAMPLE_FEATURES = 32 << 20
ORDERS = (3, 4, 5)
BITS = 18
FOLDS = 5
#: Training texts whose features are worked on at once.
BLOCK_ROWS = 250

_FOLD = LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32


def _slots(buf: np.ndarray) -> np.ndarray:
    """Feature numbers of all n-grams of one text (repeats included)."""
    text = _FOLD[buf]
    if len(text) > 1:
        text = text[np.concatenate([[True], (text[1:] != 32) | (text[:-1] != 32)])]
    parts, n = [], len(text)
    values = text.astype(np.uint32) + np.uint32(1)
    for order in ORDERS:
        if n < order:
            break
        h = np.zeros(n - order + 1, np.uint32)
        for j in range(order):
            h *= np.uint32(0x01000193)
            h ^= values[j : n - order + 1 + j]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        parts.append(h & np.uint32((1 << BITS) - 1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 40, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights per feature slot (scaling included) and the intercept; rows: each text's distinct slots."""
    size = 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(size, np.float32), 40.0 * (share - 0.5) if len(labels) else -40.0
    pos, neg = np.ones(size), np.ones(size)
    for r, label in zip(rows, labels):
        (pos if label == 1 else neg)[r] += 1.0
    ratio = np.log((pos / (labels.sum() + 2.0)) / (neg / ((1 - labels).sum() + 2.0)))
    ratio[(pos + neg) < 5] = 0.0  # seen once or twice
    used = np.abs(ratio) > 0.1
    blocks = []  # a few texts at a time, so that what is made from all features at once stays small
    for lo in range(0, len(rows), BLOCK_ROWS):
        own = [r[used[r]] for r in rows[lo : lo + BLOCK_ROWS]]
        blocks.append((slice(lo, lo + len(own)), np.concatenate(own), np.array([len(r) for r in own])))
    # each label weighs half, so that 0.5 divides them
    y = labels.astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, epochs + 1):
        g, gb = l2 * w / len(y), 0.0
        for part, flat, counts in blocks:
            row, x = np.repeat(np.arange(len(counts)), counts), ratio[flat]
            z = np.bincount(row, weights=w[flat] * x, minlength=len(counts)) + b
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) * weight[part] / len(y)
            g += np.bincount(flat, weights=err[row] * x, minlength=size)
            gb += err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return (w * ratio).astype(np.float32), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, per_label: int = SAMPLE_ROWS) -> DataFrame:
    """The bounded training sample: label_id, text, toxic."""
    clear = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    learned = clear.where(F.pmod(F.crc32(F.col("label_id").cast("string").cast("binary")), F.lit(folds)) != 0).select("label_id", "toxic")
    order = F.xxhash64("label_id")
    # documents may be missing: sample among the labels of those that are there
    there = docs.select(F.col("doc_id").alias("label_id")).join(learned, "label_id").distinct()
    picked = [there.where(F.col("toxic") == k).orderBy(order, "label_id").limit(per_label) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_label rows of two numbers
    return docs.join(sample, docs["doc_id"] == sample["label_id"]).select("label_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, per_label: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Trains on the bounded sample in one task; returns the weights and the intercept (1 MB)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            slots = [np.unique(_slots(buf[offsets[i] : offsets[i + 1]])).tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("toxic").cast(pa.int32()), pa.array([len(x) // 4 for x in slots], pa.int64()), pa.array(slots, pa.binary())], names=["label_id", "toxic", "n", "slots"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("slots")]
            toxic += batch.column("toxic").to_pylist()
        if texts:
            w, b = train(texts, np.array(toxic))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64())], names=["w", "b"])

    rows = stored(training_rows(docs, labels, folds, per_label).mapInArrow(features, "label_id long, toxic int, n long, slots binary"), "features")
    # at most 2 * per_label rows of numbers (repeated documents are counted as often as they occur)
    before = F.sum("size").over(W.partitionBy("toxic").orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(W.unboundedPreceding, 0))
    sizes = rows.groupBy("toxic", "label_id").agg(F.sum("n").alias("size"))
    first = F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("label_id"), "label_id")) == 1
    few = sizes.withColumn("fits", (before <= SAMPLE_FEATURES) | first).where("fits").select("label_id")
    rows = rows.join(F.broadcast(few), "label_id", "left_semi")
    with arrow_rows(docs.sparkSession, 64):
        model = rows.select("label_id", "toxic", "slots").repartition(1).sortWithinPartitions("label_id", "slots").mapInArrow(one, "w binary, b double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), -40.0
    return np.frombuffer(model[0]["w"], np.float32), model[0]["b"]


def score_texts(column: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    buf, offsets = buffers(column)
    seen = np.zeros(1 << BITS, dtype=bool)
    out = np.empty(len(offsets) - 1)
    for i in range(len(out)):
        z = intercept
        slots = _slots(buf[offsets[i] : offsets[i + 1]])
        if len(slots):
            seen[slots] = True
            present = np.flatnonzero(seen)
            z += float(weights[present].sum(dtype=np.float64))
            seen[present] = False
        out[i] = z
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def scores(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns to keep (all) and a last one, the score of text_col; and that column's name (one that docs doesn't have)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB
    (name,) = unused(docs.columns, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in batches:
            found = pa.array(score_texts(batch.column(batch.num_columns - 1), weights, intercept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "s"])

    own = docs.select(*[quoted(c) for c in (docs.columns if keep is None else keep)])
    # by number, as names may hold any signs
    plain = [f"c{i}" for i in range(len(own.columns))]
    given = docs.select(*[quoted(c).alias(p) for c, p in zip(own.columns, plain)], quoted(text_col).cast("string").alias("t"))
    schema = T.StructType([*[T.StructField(p, f.dataType, f.nullable, f.metadata) for p, f in zip(plain, own.schema.fields)], T.StructField("s", T.DoubleType())])
    return given.mapInArrow(run, schema).toDF(*own.columns, name), name


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = doc_columns(docs, id_col, text_col)
    model = fit(rows, labels, folds)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    scored, score = scores(rows, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score, (F.col(score) >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    model = fit(doc_columns(docs, id_col, text_col), labels, folds)
    scored, score = scores(docs, model, text_col)
    return scored.where(F.col(score) < 0.5).select(*[quoted(c) for c in docs.columns])


def fold_of(doc_id: int, folds: int = FOLDS) -> int:
    """The held-out fold is 0."""
    return zlib.crc32(str(doc_id).encode()) % folds


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
