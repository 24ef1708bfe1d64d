"""The corpus as one stream of texts, and the counting kernels over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.literals import fold_literal, fold_text, literal_hits, literals_of
from threadloom.functions.text import check_term, empty_if_null, literal_count, substring_count

POSTS, COMMENTS = "posts", "comments"
MANY_TERMS = 100  # longer lists of literals are found together; a pattern cannot be, and keeps its own search


def corpus_texts(
    posts: DataFrame, comments: DataFrame, mode: str = "strict", lowercase: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Post text (title, space, body) and comment text as ``origin, id, text``.

    "coalesce" reads a missing part as empty. "strict" loses a text with a missing part, so a post
    without a body vanishes; callers choose, because the two disagree on real data. ``carry`` names
    post columns to keep; they are null for comments.
    """
    if mode not in ("coalesce", "strict"):
        raise ValueError(f"unknown text mode: {mode}")
    parts = ("Titulo", "Texto"), ("Texto_Comentario",)
    if mode == "strict":
        # Tested on the stored columns, where the scan can use it, not on the composed text.
        posts, comments = (
            table.where(reduce(lambda a, b: a & b, [F.col(c) != "" for c in cols]))
            for table, cols in zip((posts, comments), parts)
        )

    def composed(cols: tuple[str, ...]) -> Column:
        values = [F.col(c) if mode == "strict" else empty_if_null(F.col(c)) for c in cols]
        text = F.concat(values[0], F.lit(" "), values[1]) if len(values) > 1 else values[0]
        return (F.lower(text) if lowercase else text).alias("text")

    post_texts = posts.select(F.lit(POSTS).alias("origin"), F.col("ID").alias("id"), composed(parts[0]), *carry)
    comment_texts = comments.select(F.lit(COMMENTS).alias("origin"), F.col("Post_ID").alias("id"), composed(parts[1]))
    return post_texts.unionByName(comment_texts, allowMissingColumns=True)


Counter = Callable[[Column, str], Column]


def tally(df: DataFrame, counters: Sequence[Column], shift: Column | None = None) -> DataFrame:
    """One row with a map ``sums`` from the position of a counter to its sum; sums of zero are left out.

    Any number of counters takes one reading: each row gives its counters that are not zero, which are
    folded by position inside the task, so a task ships one row per counter. ``shift`` is added to the
    positions of a row. The filter is a function over the array, so a long list makes no long generated code.
    """
    zero = F.lit(0).cast("bigint")
    values = F.array(*[F.struct(F.lit(i).alias("at"), F.coalesce(c.cast("bigint"), zero).alias("n")) for i, c in enumerate(counters)])
    extra = (shift if shift is not None else F.lit(0)).cast("int").alias("extra")
    # Outer, because the filter inferred for a plain explode would compute the array twice.
    found = df.select(extra, F.inline_outer(F.filter(values, lambda c: c["n"] > 0))).where(F.col("n").isNotNull())
    sums = found.groupBy((F.col("at") + F.col("extra")).alias("at")).agg(F.sum("n").alias("n"))
    return sums.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("sums"))


def sum_at(position: int) -> Column:
    return F.coalesce(F.col("sums")[position], F.lit(0).cast("bigint"))


def count_many(texts: DataFrame, terms: Sequence[str], any_case: bool, by: Sequence[str] = ()) -> DataFrame:
    """``term_ord``, the columns ``by`` and n of the literals that occur, found together in one reading.

    A task ships one row per literal that it found. What is broadcast has about one row per term of the list.
    """
    for term in terms:
        check_term(term)
    if any_case:
        texts = texts.withColumn("text", fold_text(F.col("text"), terms))
        terms = [fold_literal(term) for term in terms]
    # Outer, because the filter inferred for a plain explode would compute the array twice.
    hits = texts.select(*by, F.inline_outer(literal_hits(F.col("text"), terms))).where(F.col("hit").isNotNull())
    counts = hits.groupBy("hit", "longest", *by).agg(F.sum("n").alias("n"))
    shares = texts.sparkSession.createDataFrame(literals_of(terms), "hit string, longest boolean, term_ord int")
    return counts.join(F.broadcast(shares), ["hit", "longest"]).groupBy("term_ord", *by).agg(F.sum("n").alias("n"))


def _together(terms: Sequence[str], counter: Counter) -> bool:
    return len(terms) > MANY_TERMS and counter in (literal_count, substring_count)


def count_terms(texts: DataFrame, terms: Sequence[str], counter: Counter = literal_count) -> DataFrame:
    """Occurrences of every term as ``term_ord, term, n``, zero counts included."""
    if _together(terms, counter):
        every = texts.sparkSession.createDataFrame(list(enumerate(terms)), "term_ord int, term string")
        counts = count_many(texts, terms, counter is literal_count)
        return every.join(counts, "term_ord", "left").select("term_ord", "term", F.coalesce("n", F.lit(0)).alias("n"))
    rows = [F.struct(F.lit(i).alias("term_ord"), F.lit(term).alias("term"), sum_at(i).alias("n")) for i, term in enumerate(terms)]
    return tally(texts, [counter(F.col("text"), term) for term in terms]).select(F.inline(F.array(*rows)))


def count_terms_by_origin(texts: DataFrame, terms: Sequence[str], counter: Counter = literal_count) -> DataFrame:
    """Like ``count_terms`` but split into ``term_ord, term, origin, n``."""
    if _together(terms, counter):
        rows = [(i, term, origin) for origin in (POSTS, COMMENTS) for i, term in enumerate(terms)]
        every = texts.sparkSession.createDataFrame(rows, "term_ord int, term string, origin string")
        counts = count_many(texts, terms, counter is literal_count, ["origin"])
        return every.join(counts, ["term_ord", "origin"], "left").select("term_ord", "term", "origin", F.coalesce("n", F.lit(0)).alias("n"))
    shift = F.when(F.col("origin") == COMMENTS, F.lit(len(terms))).otherwise(F.lit(0))
    counts = tally(texts, [counter(F.col("text"), term) for term in terms], shift)
    rows = [
        F.struct(F.lit(i).alias("term_ord"), F.lit(term).alias("term"), F.lit(origin).alias("origin"), sum_at(i + at).alias("n"))
        for origin, at in ((POSTS, 0), (COMMENTS, len(terms)))
        for i, term in enumerate(terms)
    ]
    return counts.select(F.inline(F.array(*rows)))
