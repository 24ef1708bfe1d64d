"""URL expressions: search templates and post identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the site the search template and relative links resolve against.
SITE = "https://www.reddit.com"


def form_encoded(text: Column) -> Column:
    """Form encoding with "~" left alone and "*" escaped, unlike the JVM's own encoder."""
    encoded = F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def search_url(community: Column, keyword: Column, time_filter: str | Column = "year", site: str = SITE) -> Column:
    period = F.lit(time_filter) if isinstance(time_filter, str) else time_filter
    return F.concat(
        F.lit(f"{site}/r/"), community,
        F.lit("/search/?q="), form_encoded(keyword),
        F.lit("&restrict_sr=1&t="), period,
        F.lit("&sort=relevance"),
    )


def url_path(url: Column) -> Column:
    """Path of an absolute or relative URL: no scheme, authority, query, fragment or last-segment parameters."""
    bare = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    bare = F.regexp_replace(bare, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/]*)?", "")
    return F.regexp_replace(bare, r";[^/]*$", "")


def post_id(url: Column) -> Column:
    """Segment after the first "comments" segment, or null."""
    parts = F.split(F.btrim(url_path(url), F.lit("/")), F.lit("/"))
    at = F.array_position(parts, "comments").cast("int")
    return F.when(at > 0, F.get(parts, at))


def absolute_link(href: Column, site: str = SITE) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href)


def link_without_query(href: Column) -> Column:
    """Cut at "?" and drop trailing slashes; a fragment stays."""
    return F.regexp_replace(F.split_part(href, F.lit("?"), F.lit(1)), "/+$", "")
