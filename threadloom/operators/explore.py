"""Vocabulary exploration over the whole corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import check_patterns, pattern_count, substring_count
from threadloom.operators.texts import corpus_texts, count_terms, count_terms_by_origin
from threadloom.params import ACTION_TERMS, ANXIETY_PATTERNS, NATIVE_TERMS


def keyword_by_origin(posts: DataFrame, comments: DataFrame, terms: Sequence[str] = ACTION_TERMS, mode: str = "strict") -> DataFrame:
    """Occurrences of every term in posts and in comments, one row per pair."""
    return count_terms_by_origin(corpus_texts(posts, comments, mode), terms, substring_count)


def native_vocabulary(posts: DataFrame, comments: DataFrame, terms: Sequence[str] = NATIVE_TERMS, mode: str = "strict") -> DataFrame:
    """Occurrences of every term in the whole corpus, most frequent first."""
    counts = count_terms(corpus_texts(posts, comments, mode), terms, substring_count)
    return counts.orderBy(F.desc("n"), "term_ord").select("term", "n")


def lexicon_counts(posts: DataFrame, comments: DataFrame, patterns: Sequence[str] = ANXIETY_PATTERNS, mode: str = "strict") -> DataFrame:
    """Regex matches over lowercased texts for the patterns that occur, most frequent first."""
    check_patterns(posts.sparkSession, patterns)
    counts = count_terms(corpus_texts(posts, comments, mode), patterns, pattern_count)
    return counts.where(F.col("n") > 0).orderBy(F.desc("n"), "term_ord").select("term", "n")
