"""Plan shapes that large data depends on."""

import os

import pytest

from threadloom.operators.funnel import funnel_audit
from threadloom.params import Filters
from threadloom.plans import registry, tables
from threadloom.plans.corpus import build_corpus, publish_corpus
from threadloom.session import scratch_dir
from threadloom.sources.corpus import read_corpus
from threadloom.operators.texts import corpus_texts, count_terms

SF_DIR = "/root/testdata/sf0.001"
WRITES = {"read_records", "quarantine", "write_corpus", "build_corpus", "append_new_stream"}


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in WRITES])
def test_no_cartesian_product_and_no_python_workers(spark, name):
    text = plan(registry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in text


def test_copies_are_cut_before_the_shuffle(spark):
    posts = build_corpus(tables.document_records(spark, SF_DIR), Filters()).posts
    text = plan(posts)
    assert text.index("Final") < text.index("Exchange hashpartitioning(id") < text.index("Partial")


def test_stored_corpus_queries_read_only_their_columns(spark, tmp_path):
    posts, comments = tables.document_corpus(spark, SF_DIR)
    posts.write.parquet(str(tmp_path / "p"))
    comments.write.parquet(str(tmp_path / "c"))
    texts = corpus_texts(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "c")))
    text = plan(count_terms(texts, ["the", "and"]))
    assert "ReadSchema: struct<Titulo:string,Texto:string>" in text
    assert "ReadSchema: struct<Texto_Comentario:string>" in text
    assert "PushedFilters: [IsNotNull(Titulo), IsNotNull(Texto), Not(EqualTo(Titulo,)), Not(EqualTo(Texto,))]" in text
    assert text.count("FileScan") == 2


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_publishing_reads_the_raw_records_once(spark, tmp_path):
    records = tables.document_records(spark, SF_DIR)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    counted = records.mapInArrow(seen, records.schema)
    path = str(tmp_path / "corpus")
    before = set(os.listdir(os.path.dirname(scratch_dir(spark, "x")))) if spark.conf.get("spark.checkpoint.dir", None) else None
    stages = publish_corpus(counted, Filters(), path)
    assert reads.value == records.count()
    assert [tuple(r) for r in stages.orderBy("stage_ord").collect()] == [tuple(r) for r in funnel_audit(records, Filters()).orderBy("stage_ord").collect()]
    assert before is None or set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before


def test_published_tables_equal_the_lazy_ones(spark, tmp_path):
    records = tables.document_records(spark, SF_DIR)
    publish_corpus(records, Filters(), str(tmp_path / "corpus"))
    posts, comments = read_corpus(spark, str(tmp_path / "corpus"))
    lazy = build_corpus(records, Filters())
    assert sorted(map(str, posts.collect())) == sorted(map(str, lazy.posts.collect()))
    assert sorted(map(str, comments.collect())) == sorted(map(str, lazy.comments.collect()))
