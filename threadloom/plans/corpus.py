"""From raw records to the posts and comments tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from threadloom.functions.text import check_patterns
from threadloom.operators.funnel import apply_funnel, audit, funnel_audit, judged, survivors, to_comments, to_posts
from threadloom.operators.keyed import Order
from threadloom.params import Filters
from threadloom.schema import POSITION
from threadloom.session import drop_scratch, scratch_dir
from threadloom.sources.corpus import write_corpus
from threadloom.sources.records import conform


@dataclass(frozen=True)
class Corpus:
    posts: DataFrame
    comments: DataFrame
    audit: DataFrame


def build_corpus(records: DataFrame, filters: Filters, order: Order = POSITION) -> Corpus:
    """The three lazy results of the funnel; nothing runs until one of them is used."""
    check_patterns(records.sparkSession, filters.creator_patterns)
    records = conform(records)
    survivors = apply_funnel(records, filters, order)
    return Corpus(to_posts(survivors), to_comments(survivors), funnel_audit(records, filters, order=order))


def publish_corpus(records: DataFrame, filters: Filters, path: str, order: Order = POSITION, mode: str = "errorifexists") -> DataFrame:
    """Run the funnel once, store both tables under ``path`` and return the audit.

    The records are read and judged once, into the shared scratch folder. Posts, comments and audit each read their own
    columns of that copy: what is shuffled for posts holds no comments, and for the audit no text. The audit is
    counted before the copy is removed, and comes back as its few rows.
    """
    spark = records.sparkSession
    check_patterns(spark, filters.creator_patterns)
    copy = scratch_dir(spark, "judged")
    rows = judged(conform(records), filters, order)
    try:
        rows.write.parquet(copy)
        stored = spark.read.schema(rows.schema).parquet(copy)
        kept = survivors(stored, order)
        write_corpus(to_posts(kept), to_comments(kept, keep_study=True), path, mode=mode, compact=True)
        stages = audit(stored, order)
        return spark.createDataFrame(stages.collect(), stages.schema)
    finally:
        drop_scratch(spark, copy)
