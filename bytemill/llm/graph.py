"""Connected components over written tables, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.plans.scratch import forget, stage


def components(edges: DataFrame) -> DataFrame:
    """(v, u) for every node v that is not the least of its component u, by large-star and small-star."""
    edges = stage(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").distinct()
        large = stage(large, "large")
        low = stage(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
        before, edges = edges, stage(small, "links")
        for old in (before, least, large, low):
            forget(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == seen:
            return edges
        seen = now
