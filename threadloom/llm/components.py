"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a long, b long); the root is the least vertex it can reach.

    Alternates large-star and small-star steps until nothing changes. Every step is grouping and joining by
    vertex, with the minimum taken before the shuffle; each round is written to the scratch folder, which cuts
    the lineage. Loops from a vertex to itself give that vertex; null ends give nothing.
    """
    pairs = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).dropna()
    now = staged(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    loops = now.where("a = b").select("a", "b")
    now = now.where("a > b")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = staged(small.distinct(), label)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("a"), "b").distinct()
    known = now.unionByName(roots)
    alone = loops.join(known.select("a"), "a", "left_anti")
    return known.unionByName(alone).select(F.col("a").alias("vertex"), F.col("b").alias("root"))
