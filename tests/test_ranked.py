import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators.ranked import global_rank


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places_of_a_whole_table(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(20)]), i, "x") for i in range(n)]
    ranked = global_rank(spark.createDataFrame(rows, "score int, id long, _rank string"), [F.col("score").desc_nulls_last(), F.col("id")])
    assert ranked.columns == ["score", "id", "_rank", "rank"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["rank"], r["score"], r["id"]) for r in ranked.orderBy("rank").collect()] == [(k, s, i) for k, (s, i, _) in enumerate(want, start=1)]


def test_ranges_share_the_work(spark):
    ranked = global_rank(spark.range(100_000, numPartitions=4).select(F.xxhash64("id").alias("v")), [F.col("v")])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    sizes = [r["n"] for r in ranked.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert ranked.agg(F.max("rank")).first()[0] == 100_000 and sum(sizes) == 100_000
