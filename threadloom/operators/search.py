"""Collection planning: which searches to run, and which search a found post belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import urls
from threadloom.operators.keyed import first_n_per_key, first_per_key_keep_blank
from threadloom.params import StudyProfile

_PROFILE_ROW = "study_id string, subreddits array<string>, groups array<struct<name: string, keywords: array<string>>>"


def profile_frame(spark: SparkSession, *profiles: StudyProfile) -> DataFrame:
    """Profiles as ``study_id, subreddits, keyword_groups``, the map keeping the order of its groups."""
    rows = [(p.study_id, list(p.subreddits), [(g, list(k)) for g, k in p.keyword_groups.items()]) for p in profiles]
    # A Python dict would lose its order on the way into a map, so entries travel as an array.
    groups = F.map_from_entries("groups").alias("keyword_groups")
    return spark.createDataFrame(rows, _PROFILE_ROW).select("study_id", "subreddits", groups)


def flatten_keywords(profiles: DataFrame, groups: str = "keyword_groups") -> DataFrame:
    """One row per keyword of every profile, ordered by ``group_ord, keyword_ord``."""
    kept = [c for c in profiles.columns if c != groups]
    entries = profiles.select(*kept, F.posexplode(F.map_entries(groups)).alias("group_ord", "entry"))
    return entries.select(
        *kept, "group_ord", F.col("entry.key").alias("keyword_group"),
        F.posexplode("entry.value").alias("keyword_ord", "keyword"),
    )


def search_plan(profiles: DataFrame, communities: str = "subreddits", groups: str = "keyword_groups") -> DataFrame:
    """Every community of a profile with every keyword of the same profile.

    Both lists sit in the profile's own row, so nesting two explodes gives the product without a join.
    """
    kept = [c for c in profiles.columns if c != communities]
    each = profiles.select(*kept, F.posexplode(communities).alias("sub_ord", "subreddit"))
    return flatten_keywords(each, groups)


def search_url(plan: DataFrame, time_filter: str = "year", site: str = urls.SITE) -> DataFrame:
    return plan.withColumn("search_url", urls.search_url(F.col("subreddit"), F.col("keyword"), time_filter, site))


def distinct_links_topn(links: DataFrame, n: int, search: tuple[str, ...] = ("search_id",), link: str = "link", pos: str = "pos") -> DataFrame:
    """First ``n`` distinct links of every search in order of first appearance."""
    seen = links.groupBy(*search, link).agg(F.min(pos).alias(pos))
    return first_n_per_key(seen, list(search), [pos, link], n).withColumnRenamed("_rank", "rank")


def attribute_first_search(hits: DataFrame, extracted: str = "extracted", order: tuple[str, ...] = ("sub_ord", "kw_ord", "pos")) -> DataFrame:
    """Credit a post found by several searches to the first one whose extraction worked.

    Hits without a post id cannot be recognised again and all stay.
    """
    return first_per_key_keep_blank(hits.where(F.col(extracted)).drop(extracted), "post_id", list(order))
