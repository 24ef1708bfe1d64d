import re
import sys
from pathlib import Path

import oracle
from threadloom.llm import queries

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_line_query_equals_sql(spark):
    columns, got = oracle.spark_rows(queries.op3_line_dedup(spark, SMALL))
    want_columns, want = oracle.sql_rows(oracle.connect(SMALL), queries.SQL["op3_line_dedup"])
    assert columns == want_columns and got == want


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns and after.dtypes == docs.dtypes
        assert 0 < after.count() <= before
        docs, before = after, after.count()
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert placed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_on_edge_rows(spark, edge_docs, edge_rows):
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == edge_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    others = [p for p in (root / "threadloom").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any(re.search(r"\bllm\b", p.read_text()) for p in others)
    assert "corpus_pipeline" in sys.modules
