"""Numbers written for people: 1.2k, 2.5M, 1,234."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import stripped

# Spark's double cast also takes "1d" and "inf", so the shape is checked before casting.
_RUN = r"\d+(?:_\d+)*"
NUMBER_SHAPE = rf"^[+-]?(?:{_RUN}\.?(?:{_RUN})?|\.{_RUN})(?:e[+-]?{_RUN})?$"
# Decimal digits of every script, by the value Unicode gives them.
_DIGITS = {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x660, sys.maxunicode + 1)) if c.isdecimal()}


def parse_count(text: Column) -> Column:
    """BIGINT from an abbreviated count, truncated toward zero; anything unreadable is 0."""
    latin = F.translate(stripped(text), "".join(_DIGITS), "".join(_DIGITS.values()))
    plain = F.replace(F.lower(latin), F.lit(","), F.lit(""))
    unit = (
        F.when(plain.endswith("k"), F.lit(1_000.0))
        .when(plain.endswith("m"), F.lit(1_000_000.0))
        .otherwise(F.lit(1.0))
    )
    digits = stripped(F.regexp_replace(plain, "[km]$", ""))
    value = F.when(digits.rlike(NUMBER_SHAPE), F.replace(digits, F.lit("_"), F.lit("")).try_cast("double") * unit)
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def json_integer(text: Column) -> Column:
    """BIGINT from a JSON scalar kept as text; fractions truncate, other text is null."""
    return text.try_cast("decimal(38,6)").try_cast("bigint")
