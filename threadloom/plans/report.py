"""The whole report as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import check_patterns, literal_count, matches
from threadloom.operators.report import bar, top_discussions
from threadloom.operators.texts import COMMENTS, POSTS, corpus_texts, sum_at, tally
from threadloom.params import Analysis


# Section labels sort in report order; within a section ``ord`` does.
TOTALS, COMMUNITIES, BARS = "1a totals", "1b communities", "1c bars"
CREATORS, VOCABULARY, MATCHES, DISCUSSIONS = "2 creators", "3 vocabulary", "4 matches", "5 discussions"


def _line(section: str, order: Column, key: Column, value: Column) -> list[Column]:
    return [
        F.lit(section).alias("section"),
        order.cast("int").alias("ord"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
    ]


def _fixed(section: str, *pairs: tuple[str, Column]) -> list[Column]:
    return [F.struct(*_line(section, F.lit(i), F.lit(k), v)) for i, (k, v) in enumerate(pairs, start=1)]


def report_table(posts: DataFrame, comments: DataFrame, analysis: Analysis = Analysis(), top_k: int = 5, top_terms: int = 10) -> DataFrame:
    """Report rows ``section, ord, key, value``.

    Totals, creators, vocabulary and both expressions come from a single pass over the texts; the
    community sizes and the leading posts read a few narrow post columns.
    """
    check_patterns(posts.sparkSession, [analysis.tactics_pattern, analysis.theories_pattern])
    texts = corpus_texts(posts, comments, "coalesce", lowercase=False, carry=["is_creator_suspect"])
    text, origin = F.col("text"), F.col("origin")
    terms = analysis.vocabulary_terms

    tallies = {}
    for name, pattern in (("tactics", analysis.tactics_pattern), ("theories", analysis.theories_pattern)):
        for side in (POSTS, COMMENTS):
            tallies[f"{name} {side}"] = (origin == side) & matches(text, pattern)
    flags = {POSTS: origin == POSTS, COMMENTS: origin == COMMENTS, "creators": F.col("is_creator_suspect"), **tallies}
    counters = {name: F.when(flag, F.lit(1)) for name, flag in flags.items()}
    counters |= {f"term{i}": literal_count(text, t) for i, t in enumerate(terms)}
    counted = tally(texts, list(counters.values())).select(*[sum_at(i).alias(name) for i, name in enumerate(counters)])
    vocabulary = F.array(
        *[F.struct((-F.col(f"term{i}")).alias("less"), F.lit(i).alias("at"), F.lit(t).alias("term")) for i, t in enumerate(terms)]
    )
    ranked = F.transform(
        F.slice(F.array_sort(vocabulary), 1, top_terms),
        lambda t, i: F.struct(*_line(VOCABULARY, i + 1, t["term"], -t["less"])),
    )
    pct = F.when(F.col(POSTS) > 0, F.col("creators") / F.col(POSTS) * 100).otherwise(F.lit(0.0))
    share = ("creators", F.col("creators")), ("percent", F.bround(pct, 1)), ("others", F.col(POSTS) - F.col("creators"))
    fixed = F.array(
        *_fixed(CREATORS, *share),
        *_fixed(TOTALS, (POSTS, F.col(POSTS)), (COMMENTS, F.col(COMMENTS))),
        *_fixed(MATCHES, *[(key, F.col(key)) for key in tallies]),
    )
    parts = [counted.select(F.inline_outer(F.concat(fixed, ranked) if terms else fixed))]

    sizes = posts.groupBy(F.coalesce("Subreddit", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # One row per community of the study, so ranking them in one task is cheap.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "name"))
    largest = F.max("n").over(Window.partitionBy())
    ranked_sizes = sizes.select("name", "n", place.alias("place"), largest.alias("largest"))
    parts.append(
        ranked_sizes.select(
            F.inline(
                F.array(
                    F.struct(*_line(COMMUNITIES, F.col("place"), F.col("name"), F.col("n"))),
                    F.struct(*_line(BARS, F.col("place"), F.col("name"), bar(F.col("n"), F.col("largest")))),
                )
            )
        )
    )
    leaders = top_discussions(posts, top_k)
    details = ("id", "community", "creator", "title", "comments", "upvotes", "url")
    parts.append(
        leaders.select(
            F.inline(F.array(*[F.struct(*_line(DISCUSSIONS, F.col("rank"), F.lit(d), F.col(d))) for d in details]))
        )
    )
    return reduce(DataFrame.unionByName, parts)
