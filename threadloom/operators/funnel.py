"""The cleaning funnel: each rule on its own, their composition, and the audit of what each one dropped."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import any_pattern, contains_any, empty_if_null, matches
from threadloom.operators.keyed import Order, as_columns, first_per_key, order_key
from threadloom.params import Filters
from threadloom.schema import COMMENT_COUNT, COMMENTS_COLUMNS, POSITION, POSTS_COLUMNS


def with_comment_count(df: DataFrame) -> DataFrame:
    return df.withColumn(COMMENT_COUNT, F.coalesce(F.size("comments"), F.lit(0)))


def clean_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: empty_if_null(F.col(c)) for c in ("title", "body")})


def dedup_first(df: DataFrame, key: str = "id", order: Order = POSITION) -> DataFrame:
    """Keep the first copy of every id. All null ids are one group, and so are all empty ids."""
    return first_per_key(df, key, order)


def _enough_comments(n: int) -> Column:
    return F.col(COMMENT_COUNT) >= n


def _by_creator(patterns: Iterable[str]) -> Column:
    pattern = any_pattern(patterns)
    return matches(F.col("title"), pattern) | matches(F.col("body"), pattern)


def _enough_chars(n: int) -> Column:
    return F.length("title") + F.length("body") >= n


def _mentions(terms: Sequence[str]) -> Column:
    """Whether title, space and body together hold any of the terms, so a term may span the space.

    The lambda names the lowercased text: written out, each further term would lowercase it again.
    """
    lowered = F.lower(F.concat("title", F.lit(" "), "body"))
    return F.exists(F.array(lowered), lambda text: contains_any(text, terms))


def min_comments(df: DataFrame, n: int) -> DataFrame:
    return df.where(_enough_comments(n))


def flag_creator(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Flag posts whose title or body, each on its own, matches a creator pattern; drops nothing."""
    return df.withColumn("is_creator_suspect", _by_creator(patterns))


def min_chars(df: DataFrame, n: int) -> DataFrame:
    return df.where(_enough_chars(n))


def exclude_terms(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    return df.where(~_mentions(terms)) if terms else df


def require_any_terms(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    return df.where(_mentions(terms)) if terms else df


def _passes(filters: Filters) -> Column:
    """The dropping rules together; each looks at one record only."""
    rules = _enough_comments(filters.min_comments) & _enough_chars(filters.min_chars)
    if filters.exclude_terms:
        rules = rules & ~_mentions(filters.exclude_terms)
    if filters.require_any_terms:
        rules = rules & _mentions(filters.require_any_terms)
    return rules


def apply_funnel(records: DataFrame, filters: Filters, order: Order = POSITION, key: str = "id") -> DataFrame:
    """Records that pass every rule, with the creator flag.

    Deduplication comes first by definition: a first copy that fails a rule removes its id. The
    rules are still evaluated before the shuffle, and a failing record travels without its text and
    comments: it is needed only to claim its id.
    """
    rows = clean_text(with_comment_count(records)).withColumn("_passes", F.coalesce(_passes(filters), F.lit(False)))
    fixed = {key, "_passes", *as_columns(order)}
    slim = rows.select(*[F.col(c) if c in fixed else F.when(F.col("_passes"), F.col(c)).alias(c) for c in rows.columns])
    kept = dedup_first(slim, key, order).where("_passes").drop("_passes")
    return flag_creator(kept, filters.creator_patterns)


# Bits of the rules in the number that ``judged`` gives every record; all but the creator's drop records.
_COMMENTS, _CREATOR, _CHARS, _EXCLUDED, _REQUIRED = (1 << i for i in range(5))
_KEPT = _COMMENTS | _CHARS | _EXCLUDED | _REQUIRED


def _rule_bits(filters: Filters) -> Column:
    """Which rules a cleaned record passes, as bits; 0 with too few comments, because the later rules then don't count."""
    always = F.lit(True)
    rules = {
        _CREATOR: _by_creator(filters.creator_patterns),
        _CHARS: _enough_chars(filters.min_chars),
        _EXCLUDED: ~_mentions(filters.exclude_terms) if filters.exclude_terms else always,
        _REQUIRED: _mentions(filters.require_any_terms) if filters.require_any_terms else always,
    }
    bits = F.lit(_COMMENTS)
    for bit, rule in rules.items():
        bits = bits + F.when(rule, F.lit(bit)).otherwise(F.lit(0))
    return F.when(_enough_comments(filters.min_comments), bits).otherwise(F.lit(0))


def judged(records: DataFrame, filters: Filters, order: Order = POSITION, key: str = "id") -> DataFrame:
    """Every record with its rule bits in ``_passed``, from which ``survivors`` and ``audit`` both follow.

    A record that fails a rule keeps only what it needs to claim its id, so a stored copy of this table is little more
    than the records that pass.
    """
    rows = clean_text(with_comment_count(records)).withColumn("_passed", _rule_bits(filters))
    passes = F.col("_passed").bitwiseAND(F.lit(_KEPT)) == _KEPT
    fixed = {key, "_passed", *as_columns(order)}
    return rows.select(*[F.col(c) if c in fixed else F.when(passes, F.col(c)).alias(c) for c in rows.columns])


def survivors(judged: DataFrame, order: Order = POSITION, key: str = "id") -> DataFrame:
    """The first copies that pass every rule, with the creator flag."""
    bits = F.col("_passed")
    kept = dedup_first(judged, key, order).where(bits.bitwiseAND(F.lit(_KEPT)) == _KEPT)
    return kept.withColumn("is_creator_suspect", bits.bitwiseAND(F.lit(_CREATOR)) != 0).drop("_passed")


def funnel_audit(records: DataFrame, filters: Filters, key: str = "id", order: Order = POSITION) -> DataFrame:
    """Rows left and rows dropped after every stage, from one scan and one narrow shuffle.

    Every row is reduced to a few bits saying which rules it passes, then the bits of the first copy
    per id and the number of copies are aggregated. Partial aggregation folds a hot id inside each
    task, and no text crosses the network.
    """
    return audit(clean_text(with_comment_count(records)).withColumn("_passed", _rule_bits(filters)), order, key)


def audit(judged: DataFrame, order: Order = POSITION, key: str = "id") -> DataFrame:
    """The audit of records whose rule bits are known; reads id, order and bits alone."""
    firsts = (
        judged.select(key, F.col("_passed"), order_key(order).alias("_order"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min_by("_passed", "_order").alias("passed"))
    )

    def having(mask: int) -> Column:
        return F.count_if(F.col("passed").bitwiseAND(F.lit(mask)) == mask)

    totals = firsts.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("load"),
        F.count(F.lit(1)).alias("dedup"),
        having(_COMMENTS).alias("min_comments"),
        having(_COMMENTS | _CREATOR).alias("creator_flag"),
        having(_COMMENTS | _CHARS).alias("min_chars"),
        having(_COMMENTS | _CHARS | _EXCLUDED).alias("exclude_terms"),
        having(_KEPT).alias("require_any_terms"),
    )
    funnel = ["load", "dedup", "min_comments", "min_chars", "exclude_terms", "require_any_terms"]
    before = dict(zip(funnel[1:], funnel))
    shown = ["load", "dedup", "min_comments", "creator_flag", *funnel[3:], "output"]
    stages = [
        F.struct(
            F.lit(i).alias("stage_ord"),
            F.lit(stage).alias("stage"),
            F.col("require_any_terms" if stage == "output" else stage).alias("rows"),
            (F.col(before[stage]) - F.col(stage) if stage in before else F.lit(0).cast("bigint")).alias("dropped"),
        )
        for i, stage in enumerate(shown)
    ]
    return totals.select(F.inline(F.array(*stages)))


def to_posts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(source).alias(name) for name, source in POSTS_COLUMNS.items()])


def to_comments(df: DataFrame, keep_study: bool = False) -> DataFrame:
    """One row per comment under its post id; ``keep_study`` adds the partition column for storage."""
    study = [F.col("study_id").alias("Study_ID")] if keep_study else []
    # Outer, because the filter inferred for a plain explode would compute the array twice.
    single = df.select("id", *study, F.explode_outer("comments").alias("c")).where(F.col("c").isNotNull())
    votes = F.coalesce("c.upvotes", F.lit(0).cast("bigint"))
    values = [F.col("id"), empty_if_null(F.col("c.author")), empty_if_null(F.col("c.body")), votes]
    return single.select(*[v.alias(n) for v, n in zip(values, COMMENTS_COLUMNS)], *(["Study_ID"] if keep_study else []))
