"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import scratch_dir

# A sorted row's number is its partition and its place in it, as Spark's row numbers are laid out.
_PLACE_BITS = 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based place of every row in ``order`` as a long; ties get places in any order.

    Rows are dealt out in ranges and sorted within them; a range's first place is the number of rows before it. The
    sorted rows are written once to the shared scratch folder, so a lost task cannot change them. Only one total per
    range passes through the driver, as many as a shuffle has partitions. ``order`` should end in a unique column,
    because rows that tie in all of it share a range. An empty table gives no rows.
    """
    spark = df.sparkSession
    place = "_" + name
    while place in df.columns:
        place = "_" + place
    path = scratch_dir(spark, "ranked")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(df.schema.add(place, "long")).parquet(path)
    part = F.shiftright(place, _PLACE_BITS)
    totals = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((n for _, n in totals[:-1]), initial=0)
    starts = {p: b for (p, _), b in zip(totals, before)}
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("long")).drop(place)
    first = spark.createDataFrame(list(starts.items()), "_part long, _before long")
    within = F.col(place).bitwiseAND((1 << _PLACE_BITS) - 1)
    ranked = placed.join(F.broadcast(first), part == F.col("_part"))
    return ranked.withColumn(name, F.col("_before") + within + 1).drop(place, "_part", "_before")
