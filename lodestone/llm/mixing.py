"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's mean repetition rate is the size that its target weight grants it
divided by the size it has.  Each document's number of copies is the inverse
of the Poisson distribution with that mean at a uniform number hashed from the
seed and the document, so a rerun, or the recomputation of a lost task, gives
the same copies.  The copies are dealt over all partitions by a second hash
and ordered by it inside each one.

Sizes are characters of whole texts.  Without explicit weights a source's
weight is the square root of its size, and the output is as large as the input.

Defined cases: a null source is a source of its own; a null or empty text has
size 0 and is replicated at its source's rate; a source whose texts are all
empty, or that has weight 0 or no entry in explicit weights, gives no rows;
repeated rows draw the same number of copies each; an empty table gives no
rows.  Texts of any length are counted whole and passed through; so are other
columns, whatever their names (see `mix` for the name of its own).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, read_table, stored, unused

SEED = "mix-1"
#: Numbers in all sources' distributions together up to which their table is broadcast (4 MB).
BROADCAST_NUMBERS = 500_000
#: Parts of each source in the join that takes the broadcast's place beyond that.
SALTS = 64
#: Copies of a document that are listed at once.
STRETCH = 1 << 16
_HEX = 13  # hexadecimal digits of md5 that make a uniform number: 52 bits, exact in a double


def _hash(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1), hashed from the seed and the parts."""
    return (F.conv(F.substring(_hash(seed, *parts), 1, _HEX), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(16**_HEX))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, out_chars: int | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per source: n_docs, chars, rate (its mean number of copies)."""
    size = F.coalesce(F.char_length(quoted(text_col).cast("string")), F.lit(0)).cast("long")
    stats = docs.select(quoted(source_col).cast("string").alias("source"), size.alias("size")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("chars"))
    if weights is None:
        weight = F.sqrt(F.col("chars").cast("double"))
    else:
        known = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (str(k), float(w))]) if weights else None
        weight = F.coalesce(F.element_at(known, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)) if known is not None else F.lit(0.0)
    stats = stats.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = stats.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    granted = F.col("weight") / F.col("all_weight") * (F.lit(float(out_chars)) if out_chars is not None else F.col("all_chars").cast("double"))
    rate = F.when(F.col("weight") > 0, granted / F.col("chars").cast("double")).otherwise(0.0)
    return stats.join(F.broadcast(total)).select("source", "n_docs", "chars", "weight", rate.alias("rate"))  # one row


def _log_factorial(i: Column) -> Column:
    """Exact up to 20, by Stirling's series beyond."""
    n = i.cast("double")
    series = 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5) - 1 / (1680 * n**7) + 1 / (1188 * n**9)
    return F.when(i <= 20, F.log(F.factorial(F.least(i, F.lit(20)).cast("int")).cast("double"))).otherwise((n + 0.5) * F.log(n) - n + 0.5 * math.log(2 * math.pi) + series)


def distributions(rates_: DataFrame) -> DataFrame:
    """source, rate, least, cumulative: the Poisson probabilities of up to least, least + 1, ... copies.

    Only counts around the mean are listed: all others together are less
    probable than a double below 1 tells apart.  So a source's list has about
    24 * sqrt(rate) numbers, each computed by itself.
    """
    width = 12 * F.sqrt("rate") + 25
    spans = rates_.select("source", "rate", F.greatest(F.lit(0.0), F.floor(F.col("rate") - width)).cast("long").alias("least"), F.ceil(F.col("rate") + width).cast("long").alias("most"))
    counts = spans.where("rate > 0").select("source", "rate", "least", F.explode(F.sequence("least", "most")).alias("i"))
    terms = counts.withColumn("p", F.exp(F.col("i").cast("double") * F.log("rate") - F.col("rate") - _log_factorial(F.col("i"))))
    summed = terms.withColumn("c", F.sum("p").over(W.partitionBy("source", "rate").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    listed = summed.groupBy("source", "rate", "least").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("listed"))
    return listed.select("source", "rate", "least", F.col("listed.c").alias("cumulative"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, out_chars: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of docs, then a struct of copy (from 1), copies, rate and shuffle_key; rows in shuffled order.

    The struct is named "mixed", with underscores behind it where docs has that column.
    """
    out = unused(docs.columns, "mixed")[0]
    per_source = stored(distributions(rates(docs, weights, out_chars, source_col, text_col)), "rates")
    numbers = per_source.agg(F.sum(F.size("cumulative") + 3)).first()[0] or 0
    # the document's columns lie in a struct, so that no name can clash
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"), quoted(id_col).alias("id"), quoted(source_col).cast("string").alias("own_source"))
    of_source = F.col("own_source").eqNullSafe(F.col("source"))
    if numbers <= BROADCAST_NUMBERS:
        joined = rows.join(F.broadcast(per_source), of_source)
    else:  # a source of any size is dealt over its parts
        own = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(SALTS)).cast("int")
        parts_of = per_source.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", own).join(parts_of, of_source & (F.col("own") == F.col("part")))
    u = uniform(seed + "-count", F.col("id"))
    copies = F.when(F.col("u") < F.get("cumulative", F.lit(0)), F.col("least")).otherwise(F.col("least") + F.size(F.filter("cumulative", lambda c: F.col("u") >= c)))
    counted = joined.withColumn("u", u).select("doc", "id", "rate", copies.alias("copies")).where("copies > 0")
    # in two steps, so that no list of a document's copies grows with its rate
    stretches = counted.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STRETCH).cast("long"))))
    first = F.col("stretch") * STRETCH + 1
    exploded = stretches.select("doc", "id", "rate", "copies", F.explode(F.sequence(first, F.least(first + (STRETCH - 1), F.col("copies")))).alias("copy"))
    ordered = exploded.withColumn("shuffle_key", F.substring(_hash(seed + "-order", F.col("id"), F.col("copy")), 1, 16))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("doc.*", F.struct("copy", "copies", "rate", "shuffle_key").alias(out))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "text", F.col("mixed.copy").cast("int").alias("copy"), F.col("mixed.copies").cast("int").alias("copies"), F.round("mixed.rate", 6).alias("rate"), F.col("mixed.shuffle_key").alias("shuffle_key"))


OP4_SQL = """
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source),
w AS (SELECT source, chars, sqrt(chars::DOUBLE) AS weight FROM s WHERE chars > 0),
r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (SELECT sum(chars)::DOUBLE FROM s) / chars::DOUBLE AS rate FROM w),
t AS (SELECT source, rate, i, exp(i * ln(rate) - rate - CASE WHEN i > 1 THEN lgamma(i + 1.0) ELSE 0 END) AS p FROM r, (SELECT unnest(range(0, 400)) AS i)),
c AS (SELECT source, rate, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cdf FROM t WHERE i <= ceil(rate + 12 * sqrt(rate) + 25)),
u AS (SELECT doc_id, source, text, (('0x' || substr(md5('mix-1-count|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, any_value(u.text) AS text, any_value(c.rate) AS rate, count(*) FILTER (WHERE u.u >= c.cdf) AS copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source)
SELECT doc_id, source, text, copy::INTEGER AS copy, copies::INTEGER AS copies, round(rate, 6) AS rate,
       substr(md5('mix-1-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
"""
