"""Connected components as alternating large-star and small-star rounds of equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, discard, materialize


def components(edges: DataFrame, shuffled: bool = False) -> DataFrame:
    """edges (a, b long) to (node, root): the smallest node of each component, itself left out.

    Each round groups by node with partial sums and joins the minimum back, so a hub is never one task's group; the
    edges between rounds are tables in the shared folder, each removed when the next is written. Rounds stop when the edge set repeats.
    shuffled: no round's minima go through the driver, however few they are.
    """
    order = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    side = by_shuffle if shuffled else lambda d: d
    at = materialize(order(edges), "edges")
    last = mark(at)
    while last[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, at = at, materialize(small.distinct(), "edges")
        discard(before)
        now = mark(at)
        if now == last:
            break
        last = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
