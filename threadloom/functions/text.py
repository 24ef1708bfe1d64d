"""Text expressions: pattern dialect, literal matching and occurrence counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Study patterns follow Python's dialect: i = ignore case, u/U = Unicode case and classes,
# d = only \n ends a line (Java would also stop "." and "$" at \r, NEL and the separators).
IGNORE_CASE = "(?iuUd)"
EXACT_CASE = "(?uUd)"


def any_pattern(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"{IGNORE_CASE}(?:{pattern})")


def check_patterns(spark: SparkSession, patterns: Iterable[str]) -> None:
    """Fail on the driver when the JVM cannot compile a pattern (folded away, so no job runs)."""
    probes = [matches(F.lit(""), p) for p in patterns]
    if probes:
        spark.sql("SELECT 1").select(*[p.alias(f"p{i}") for i, p in enumerate(probes)]).collect()


def quoted(term: str) -> str:
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def check_term(term: str) -> None:
    if not term.strip():
        raise ValueError("a term to count must not be blank")


def literal_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal, any case."""
    check_term(term)
    return F.regexp_count(text, F.lit(f"(?iu){quoted(term)}"))


def substring_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal, case as given; byte arithmetic, no regex engine."""
    check_term(term)
    shrunk = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return (shrunk / F.lit(len(term.encode()))).cast("bigint")


def pattern_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"{EXACT_CASE}(?:{pattern})"))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True when any term, lowercased, is a substring of an already lowercased text."""
    return reduce(lambda a, b: a | b, [text.contains(F.lower(F.lit(t))) for t in terms])


# Every character Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    """Without leading and trailing white space; looks only at the ends of the text."""
    return F.btrim(text, F.lit(WHITESPACE))


def empty_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))
