"""First row(s) per key, written so that one hot key stays cheap.

A ``row_number() <= n`` filter right above its window makes Spark keep at most ``n`` rows per key
inside every task before the shuffle, so a key holding a third of the table reaches its reducer as
a few rows per map task instead of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# spark.sql.optimizer.windowGroupLimitThreshold by default: above it nothing is dropped map-side.
GROUP_LIMIT = 1000
SALTS = 256


# Name(s) of the ordering columns: ascending, never null, and without ties within a key.
Order = str | Sequence[str]


def as_columns(order: Order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def order_key(order: Order) -> Column:
    """One comparable column standing for a whole ordering."""
    cols = as_columns(order)
    return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)


def _ranked(df: DataFrame, keys: Sequence[str], order: Order, n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*as_columns(order))
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)


def first_per_key(df: DataFrame, key: str, order: Order) -> DataFrame:
    """Lowest-ordered row of every key; all null keys form one group."""
    return _ranked(df, [key], order, 1).drop("_rank")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Order, n: int) -> DataFrame:
    """Lowest-ordered ``n`` rows of every key, with their 1-based rank in ``_rank``."""
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*as_columns(order)), F.lit(SALTS))
        df = _ranked(df.withColumn("_salt", salt), [*keys, "_salt"], order, n).drop("_rank", "_salt")
    return _ranked(df, keys, order, n)


def is_blank(key: str) -> Column:
    return F.col(key).isNull() | (F.col(key) == "")


def first_per_key_keep_blank(df: DataFrame, key: str, order: Order) -> DataFrame:
    """Like ``first_per_key``, but rows with a null or empty key never compete and are all kept."""
    keyed = first_per_key(df.where(~is_blank(key)), key, order)
    return keyed.unionByName(df.where(is_blank(key)))
