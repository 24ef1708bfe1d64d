"""Tables derived from captured pages: links, post fields, comments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import urls
from threadloom.functions.counts import parse_count
from threadloom.functions.html import (
    ANCHOR_HREF,
    Selector,
    attribute,
    balanced,
    element,
    elements,
    first_match,
    having,
    inner_text,
    inside,
    let,
    page_tags,
    page_tokens,
    part_of,
    unescape,
    unquoted,
    visible,
    with_class,
)
from threadloom.functions.text import stripped

USER_LINK = rf"a\b{having('href', '/user/', '*')}"


@dataclass(frozen=True)
class PageFields:
    """Selectors per field; the earliest match in the page wins."""

    # Where the forum's page layouts keep each field.
    title: tuple[Selector, ...] = (element(r"h1\b"), element(having("data-testid", "post-title")))
    author: tuple[Selector, ...] = (attribute(USER_LINK, "href"), attribute(having("data-testid", "post_author_link"), "href"))
    body: tuple[Selector, ...] = (
        element(having("data-testid", "post-rtjson-content")),
        element(with_class("RichTextJSON-root")),
        inside(having("slot", "text-body"), "p"),
    )
    votes: tuple[Selector, ...] = (
        element(rf"faceplate-number\b{having('pretty')}"),
        element(having("id", "vote-count", "*")),
        inside(having("data-testid", "vote-arrows"), "faceplate-number"),
    )
    comment_count: tuple[Selector, ...] = (
        inside(rf"a\b{having('href', '/#newcomments', '$')}", "faceplate-number"),
        element(having("data-testid", "comment-count")),
    )
    timestamp: tuple[Selector, ...] = (attribute(r"time\b[^>]*\sdatetime", "datetime"),)


@dataclass(frozen=True)
class CommentFields:
    """Comment containers, tried in order until one occurs, and selectors within a comment."""

    # The three comment layouts and their parts.
    containers: tuple[str, ...] = (r"shreddit-comment\b", rf"[a-z][\w-]*\b{with_class('Comment')}", rf"[a-z][\w-]*\b{having('data-testid', 'comment')}")
    author: tuple[Selector, ...] = (element(USER_LINK), element(having("slot", "authorName")))
    body: tuple[Selector, ...] = (
        inside(having("slot", "comment"), "p"),
        inside(with_class("RichTextJSON-root"), "p"),
        inside(with_class("md"), "p"),
    )
    score: tuple[Selector, ...] = (element(r"faceplate-number\b"), element(with_class("score")), element(having("data-testid", "comment-score")))


def _texts(found: list[Column]) -> Column:
    """Fragments as an array of plain texts, empty where nothing was found."""
    return F.transform(F.array(*found), lambda f: F.coalesce(inner_text(f), F.lit("")))


def _attributes(found: list[Column]) -> Column:
    return F.transform(F.array(*found), lambda f: F.coalesce(stripped(unescape(unquoted(f))), F.lit("")))


def extract_links(
    pages: DataFrame,
    community: str | Column,
    anchor_contains: str = "/comments/",
    keep: Column | None = None,
    site: str = urls.SITE,
) -> DataFrame:
    """Post links of a community in page order: ``pos, link`` next to the page's own columns but its HTML.

    Anchors must contain ``anchor_contains``; links must contain ``keep``, by default the community's
    post path. Relative links become absolute, queries and trailing slashes go, fragments stay.
    """
    name = F.lit(community) if isinstance(community, str) else community
    wanted = F.concat(F.lit("/r/"), name, F.lit("/comments/")) if keep is None else keep
    hrefs = F.transform(F.regexp_extract_all(visible(F.col("html")), F.lit(ANCHOR_HREF), 1), lambda q: unescape(unquoted(q)))
    kept = [c for c in pages.columns if c != "html"]
    found = pages.select(*kept, wanted.alias("_wanted"), F.posexplode(hrefs).alias("pos", "href"))
    absolute = found.where(F.contains("href", F.lit(anchor_contains))).withColumn("href", urls.absolute_link(F.col("href"), site))
    matching = absolute.where(F.contains("href", "_wanted"))
    return matching.select(*kept, "pos", urls.link_without_query(F.col("href")).alias("link"))


def _read(pages: DataFrame) -> DataFrame:
    """Pages with their tokens and tags, both computed once for everything that is asked of them."""
    kept = [c for c in pages.columns if c != "html"]
    cut = pages.select(*kept, page_tokens(visible(F.col("html"))).alias("_tokens"))
    return cut.select(*kept, "_tokens", _once(page_tags(F.col("_tokens"))).alias("_tags"))


def _fields(layout: PageFields) -> dict[str, Column]:
    """The texts and attributes of a read page, before they get their types."""

    def first(selectors: tuple[Selector, ...]) -> Column:
        return first_match(F.col("_tokens"), F.col("_tags"), selectors)

    texts = _texts([first(s) for s in (layout.title, layout.body, layout.votes, layout.comment_count)])
    return {"_texts": texts, "_attributes": _attributes([first(s) for s in (layout.author, layout.timestamp)])}


def _typed_fields() -> list[Column]:
    texts, attributes = F.col("_texts"), F.col("_attributes")
    user = F.regexp_replace(attributes[0], "^/+|/+$", "")
    return [
        F.coalesce(urls.post_id(F.col("url")), F.lit("")).alias("id"),
        texts[0].alias("title"),
        F.element_at(F.split(user, "/"), -1).alias("author"),
        texts[1].alias("body"),
        parse_count(texts[2]).alias("upvotes"),
        parse_count(texts[3]).alias("comment_count"),
        attributes[1].alias("timestamp"),
    ]


def _comments(layout: CommentFields, max_comments: int) -> Column:
    """The first container kind that occurs is used; of its elements the first ``max_comments`` count."""
    tokens, tags = F.col("_tokens"), F.col("_tags")
    kinds = F.filter(F.array(*[elements(tags, c) for c in layout.containers]), lambda found: F.size(found) > 0)
    opened = F.slice(F.coalesce(F.get(kinds, F.lit(0)), F.slice(tags, 1, 0)), 1, max_comments)
    chosen = balanced(tags, opened, F.size(tokens))

    def comment(c: Column) -> Column:
        def read(own: Column) -> Column:
            found = [first_match(tokens, own, s, c["close"]) for s in (layout.author, layout.body, layout.score)]
            return let(_texts(found), lambda t: F.struct(t[0].alias("author"), t[1].alias("body"), parse_count(t[2]).alias("upvotes")))

        return let(part_of(tags, c), read)

    return F.filter(F.transform(chosen, comment), lambda c: (c["author"] != "") | (c["body"] != ""))


def _once(value: Column) -> Column:
    """A value behind a generator: the filter that Spark infers for a later explode would compute it a second time."""
    return F.explode(F.array(value))


def page_fields(pages: DataFrame, layout: PageFields = PageFields()) -> DataFrame:
    """Post fields of every page; what a page lacks is empty text or 0."""
    kept = [c for c in pages.columns if c != "html"]
    return _read(pages).select(*kept, *[v.alias(n) for n, v in _fields(layout).items()]).select(*kept, *_typed_fields())


def page_comments(pages: DataFrame, max_comments: int, layout: CommentFields = CommentFields()) -> DataFrame:
    """Pages with their ``comments`` array; comments with neither author nor body are dropped after the limit."""
    kept = [c for c in pages.columns if c != "html"]
    return _read(pages).select(*kept, _once(_comments(layout, max_comments)).alias("comments"))


def page_posts(
    pages: DataFrame, max_comments: int, fields: PageFields = PageFields(), comments: CommentFields = CommentFields()
) -> DataFrame:
    """Fields and comments of every page from one reading of its HTML."""
    kept = [c for c in pages.columns if c != "html"]
    read = [v.alias(n) for n, v in _fields(fields).items()]
    found = _read(pages).select(*kept, *read, _once(_comments(comments, max_comments)).alias("comments"))
    return found.select(*kept, *_typed_fields(), "comments")
