"""One key holding a third of the rows must shrink inside its tasks, before the shuffle."""

from pyspark.sql import functions as F

from threadloom.operators import funnel, search
from threadloom.operators.keyed import first_per_key_keep_blank
from threadloom.params import Filters
from threadloom.sources.corpus import append_new

ROWS, TASKS = 30_000, 6


def skewed(spark, hot):
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("k"), F.col("id")))
    return spark.range(0, ROWS, 1, TASKS).select(
        key.alias("id"), F.col("id").alias("_pos"), F.lit("some title").alias("title"), F.lit("some body").alias("body"),
        F.expr("transform(sequence(1, 3), i -> struct('u' AS author, 'c' AS body, CAST(i AS BIGINT) AS upvotes))").alias("comments"),
    )


def shuffled(df, metric="shuffleRecordsWritten"):
    """What every shuffle of the executed plan wrote."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    written = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            written.append(node.metrics().apply(metric).value())
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ResultQueryStageExec": "plan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}.get(name)
        if inner:
            walk(getattr(node, inner)())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return written


def test_hot_id_in_deduplication(spark):
    for hot in ("hot", "", None):
        records = skewed(spark, hot)
        assert funnel.dedup_first(records).where(F.col("id").eqNullSafe(hot)).select("_pos").first()[0] == 0
        (written,) = shuffled(funnel.dedup_first(records))
        assert written <= ROWS * 2 // 3 + TASKS


def test_hot_id_in_the_audit(spark):
    audit = funnel.funnel_audit(skewed(spark, None), Filters(min_chars=1))
    assert max(shuffled(audit)) <= ROWS * 2 // 3 + TASKS
    assert [r.rows for r in audit.orderBy("stage_ord").collect()][:2] == [ROWS, ROWS * 2 // 3 + 1]


def test_failing_records_shuffle_without_their_payload(spark):
    wide = F.when(F.col("_pos") % 10 == 0, F.lit("keep ")).otherwise(F.lit("drop "))
    records = skewed(spark, "hot").withColumn("body", F.concat(wide, F.repeat(F.sha2(F.col("id"), 256), 20)))
    kept = funnel.apply_funnel(records, Filters(require_any_terms=("keep",)))
    (slim,), (full,) = shuffled(kept, "dataSize"), shuffled(funnel.dedup_first(records), "dataSize")
    assert slim < full / 3
    assert kept.count() == funnel.dedup_first(records).where(F.col("body").startswith("keep")).count() > 0


def test_hot_id_in_the_append(spark):
    incoming, stored = skewed(spark, "hot"), skewed(spark, "k1")
    fresh = append_new(incoming, stored)
    assert [r.id for r in fresh.collect()] == ["hot"]
    assert max(shuffled(append_new(incoming, stored))) <= ROWS * 2 // 3 + TASKS


def test_blank_ids_never_shuffle(spark):
    kept = first_per_key_keep_blank(skewed(spark, ""), "id", "_pos")
    assert max(shuffled(kept)) <= ROWS * 2 // 3
    assert kept.count() == ROWS


def test_hot_search(spark):
    links = spark.range(0, ROWS, 1, TASKS).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 100)).alias("search_id"),
        F.concat(F.lit("l"), F.col("id")).alias("link"), F.col("id").alias("pos"),
    )
    top = search.distinct_links_topn(links, 5)
    assert top.where("search_id = 'hot'").count() == 5
    assert min(shuffled(top)) < 101 * 5 * 20
