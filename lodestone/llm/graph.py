"""Connected components of link tables of any size, as shuffles of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


#: Links of a written part, about, and parts at least.
PART_LINKS, LEAST_PARTS = 20_000, 8


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes with a link; links: a, b.

    Alternating large-star and small-star rounds: every node's neighbours are
    linked to the smallest of them, until the links are stars around each
    component's smallest node.  Minima are summed up before they are shuffled,
    and are written before they are joined: a join whose sides are dealt by it
    alone splits a hub's links under adaptive execution.
    """
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    # links only become fewer: small tables are written as a few files, whatever the number of shuffle partitions
    parts = min(most, max(LEAST_PARTS, -(-edges.count() // PART_LINKS)))
    kept = lambda df, tag: stored(df.coalesce(parts), tag)
    state = None
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, "links")
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = kept(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(before, least, large, low)
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
