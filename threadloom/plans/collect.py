"""From search hits and captured pages to raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import urls
from threadloom.operators.keyed import first_per_key
from threadloom.operators.pages import page_posts
from threadloom.operators.search import attribute_first_search
from threadloom.params import StudyProfile
from threadloom.schema import RECORD_SCHEMA
from threadloom.sources.records import stamp_study


def collect_records(hits: DataFrame, pages: DataFrame, profile: StudyProfile) -> DataFrame:
    """Records of the captured posts, each credited to the first search that found it.

    ``hits`` holds ``subreddit, keyword_group, keyword, sub_ord, kw_ord, pos, link``; ``pages`` holds
    ``page_id, url, html``, where ``page_id`` is unique and the lowest one of a url counts. A hit whose page was not
    captured claims nothing. Attribution and the choice of page run on link columns only; HTML is read once, for the
    pages that won.
    """
    captured = first_per_key(pages.select("url", "page_id"), "url", "page_id")
    known = captured.select(F.col("url").alias("link"), F.lit(True).alias("extracted"))
    tried = hits.withColumn("post_id", F.coalesce(urls.post_id(F.col("link")), F.lit(""))).join(known, "link", "left")
    credited = attribute_first_search(tried.withColumn("extracted", F.coalesce("extracted", F.lit(False))))
    posts = credited.select("subreddit", "keyword_group", "keyword", F.col("link").alias("url")).join(captured, "url")
    posts = posts.join(pages.select("page_id", "html"), "page_id")
    full = page_posts(posts, profile.search.max_comments_per_post)
    return stamp_study(full, profile.study_id, profile.theme_label).select(*RECORD_SCHEMA.fieldNames())
