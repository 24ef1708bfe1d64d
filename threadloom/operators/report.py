"""The corpus report, section by section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import check_patterns, matches
from threadloom.operators.texts import COMMENTS, POSTS, corpus_texts, count_terms

BAR, BAR_WIDTH = "█", 20
TITLE_CHARS = 100


def corpus_totals(posts: DataFrame, comments: DataFrame) -> DataFrame:
    def counted(name: str, table: DataFrame) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")

    return counted(POSTS, posts).unionByName(counted(COMMENTS, comments))


def group_counts(df: DataFrame, col: str, mode: str = "strict") -> DataFrame:
    """Rows per group, largest first; equal sizes by name. "strict" leaves rows without a group out, "coalesce" counts them as ""."""
    return _sizes(df, col, mode).orderBy(F.desc("n"), "name")


def _sizes(df: DataFrame, col: str, mode: str) -> DataFrame:
    if mode not in ("coalesce", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    rows = df.where(F.col(col).isNotNull()) if mode == "strict" else df
    return rows.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def bar(n: Column, largest: Column) -> Column:
    """Text bar relative to the largest group. The order of operations fixes the float rounding."""
    length = F.least((n / largest * BAR_WIDTH).cast("int"), F.lit(BAR_WIDTH))
    return F.repeat(F.lit(BAR), length)


def distribution(df: DataFrame, col: str, mode: str = "coalesce") -> DataFrame:
    """Group counts with their bars; the largest count is a scalar, so no global window is needed."""
    sizes = _sizes(df, col, mode)
    largest = sizes.agg(F.max("n")).scalar()
    return sizes.select("name", "n", bar(F.col("n"), largest).alias("bar")).orderBy(F.desc("n"), "name")


def creator_share(posts: DataFrame) -> DataFrame:
    flagged = F.count_if("is_creator_suspect")
    everyone = F.count(F.lit(1))
    return posts.agg(
        flagged.alias("creators"),
        F.when(everyone > 0, flagged / everyone * 100).otherwise(F.lit(0.0)).alias("pct"),
        (everyone - flagged).alias("others"),
    )


def term_counts(posts: DataFrame, comments: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Any-case literal occurrences per term over posts and comments."""
    return count_terms(corpus_texts(posts, comments, "coalesce", lowercase=False), terms)


def top_terms(posts: DataFrame, comments: DataFrame, terms: Sequence[str], k: int = 10) -> DataFrame:
    """Most frequent terms with their rank; zero counts stay and ties keep the order of ``terms``."""
    return ranked_terms(term_counts(posts, comments, terms), k)


def ranked_terms(counts: DataFrame, k: int) -> DataFrame:
    # One row per term of the study, never per text: the unpartitioned window stays tiny.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "term_ord"))
    return counts.select(place.alias("rank"), "term", "n").where(F.col("rank") <= k)


def match_counts(posts: DataFrame, comments: DataFrame, pattern: str) -> DataFrame:
    """Posts and comments with at least one match, as one row."""
    check_patterns(posts.sparkSession, [pattern])
    texts = corpus_texts(posts, comments, "coalesce", lowercase=False)
    hit = matches(F.col("text"), pattern)
    return texts.agg(*[F.count_if((F.col("origin") == o) & hit).alias(o) for o in (POSTS, COMMENTS)])


def match_tactics(posts: DataFrame, comments: DataFrame, tactics_pattern: str) -> DataFrame:
    return match_counts(posts, comments, tactics_pattern)


def match_theories(posts: DataFrame, comments: DataFrame, theories_pattern: str) -> DataFrame:
    return match_counts(posts, comments, theories_pattern)


def top_discussions(posts: DataFrame, k: int = 5) -> DataFrame:
    """Most commented posts, ids breaking ties; only ``k`` rows per task reach the final sort."""
    order = [F.desc("comments"), F.asc("id")]
    top = posts.select(
        F.col("ID").alias("id"),
        F.col("Subreddit").alias("community"),
        F.coalesce("is_creator_suspect", F.lit(False)).alias("creator"),
        F.substring("Titulo", 1, TITLE_CHARS).alias("title"),
        F.col("Num_Comentarios").alias("comments"),
        F.col("Upvotes").alias("upvotes"),
        F.col("URL").alias("url"),
    ).orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "*")
