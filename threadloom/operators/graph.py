"""Which study terms occur together, as pair counts and as a graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms per BIGINT of the presence mask; the sign bit stays clear.
WORD = 62


def _presence(text: Column, terms: Sequence[str]) -> list[Column]:
    """The set of terms a lowercased text holds, as a few integers."""
    words = []
    for start in range(0, len(terms), WORD):
        bits = [
            F.when(text.contains(F.lit(t)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for i, t in enumerate(terms[start:start + WORD])
        ]
        words.append(reduce(lambda a, b: a + b, bits).alias(f"w{start // WORD}"))
    return words


def cooccurrence(texts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Texts holding both terms of a pair, as ``u, v, weight`` with ``u <= v``.

    Texts are first reduced to distinct term sets with a count, inside each task, so pairs are
    expanded per set instead of per text and the text never leaves its task.
    """
    sets = texts.select(*_presence(F.col("text"), terms))
    words = sets.columns
    sets = sets.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    held = [
        F.when(F.shiftright(F.col(f"w{i // WORD}"), i % WORD).bitwiseAND(F.lit(1)) == 1, F.lit(t))
        for i, t in enumerate(terms)
    ]
    # Outer generators: a filter on the set size would be pushed down to every text.
    firsts = sets.select(F.array_compact(F.array(*held)).alias("held"), "n").select(
        "held", "n", F.posexplode_outer("held").alias("at", "a")
    )
    later = F.slice("held", F.col("at") + 2, F.size("held"))
    pairs = firsts.select("a", "n", F.explode_outer(later).alias("b")).where(F.col("b").isNotNull())
    return pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("n").alias("weight"))


def _category(term: Column, categories: Mapping[str, Sequence[str]]) -> Column:
    pairs = {t: name for name, members in reversed(list(categories.items())) for t in members}
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, term)


def cooccurrence_graph(pairs: DataFrame, categories: Mapping[str, Sequence[str]], min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Vertices ``term, category`` and edges ``u, v, weight, width`` of the pairs above ``min_weight``."""
    edges = pairs.where(F.col("weight") > min_weight).withColumn("width", F.col("weight") * 0.5)
    ends = edges.select(F.explode(F.array("u", "v")).alias("term")).distinct()
    return ends.withColumn("category", _category(F.col("term"), categories)), edges
