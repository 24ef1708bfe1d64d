"""Descriptive statistics of one numeric column, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A rank is located in rounds that settle so many bits of a 64-bit key each, so no round has more than
# 2^16 groups per rank, whatever the values.
DIGIT, KEY_BITS = 16, 64
INTEGERS = ("tinyint", "smallint", "int", "bigint")
QUARTILES = (0.25, 0.5, 0.75)
KERNEL_REACH = 39.0  # bandwidths; exp(-z*z/2) is zero as a double from 38.61 on


def corpus_summary(posts: DataFrame, comments: DataFrame) -> DataFrame:
    per_post = posts.agg(
        F.count(F.lit(1)).alias("posts"),
        F.avg("Num_Comentarios").alias("mean_comments"),
        (F.avg(F.col("is_creator_suspect").cast("int")) * 100).alias("pct_creators"),
    )
    total = comments.agg(F.count(F.lit(1))).scalar()
    return per_post.select("posts", total.alias("comments"), "mean_comments", "pct_creators")


def _present(df: DataFrame, col: str) -> Column:
    v = F.col(col)
    return v.isNotNull() & ~F.isnan(v) if dict(df.dtypes)[col] in ("double", "float") else v.isNotNull()


def _values(df: DataFrame, col: str) -> DataFrame:
    """The column as ``v``, without nulls and NaN."""
    return df.where(_present(df, col)).select(F.col(col).alias("v"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct values ``v`` with their frequency ``k``."""
    return _values(df, col).groupBy("v").agg(F.count(F.lit(1)).alias("k"))


def _sort_key(v: Column, dtype: str) -> Column:
    """A BIGINT that orders like the values and is never null: the integer itself, else the bits of the double with its sign.

    Powers of two and the scaling by them are exact, so different doubles have different keys.
    """
    if dtype in INTEGERS:
        return F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))
    x = F.abs(v.cast("double"))

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e)

    # The logarithm may round across a power of two; comparing with the powers themselves settles it.
    guess = F.floor(F.log2(x))
    e = F.when(x < power(guess), guess - 1).when(x >= power(guess + 1), guess + 1).otherwise(guess)
    normal = (e + 1023) * (1 << 52) + ((x / power(e) - 1.0) * 2.0**52).cast("bigint")
    tiny = (x * 2.0**537 * 2.0**537).cast("bigint")
    size = F.when(x == float("inf"), F.lit(2047 << 52)).when(x < 2.0**-1022, tiny).otherwise(normal)
    return F.coalesce(F.when(v < 0, -size).otherwise(size), F.lit(0).cast("bigint"))


def exact_quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row with the interpolated quantiles ``q0, q1, …`` of a value-count table.

    A percentile aggregate would gather every distinct value in one task. Here the leading bits of the
    keys are totalled, the group that holds a rank is found among them, and only its values go into the
    next round, until a single value is left. Values are never sorted, and a task sees at most 2^16
    totals per rank. All rounds read the same counts, whose shuffle Spark reuses.
    """
    keyed = counts.select("v", "k", _sort_key(F.col("v"), dict(counts.dtypes)["v"]).alias("key"))

    def leading(bits: int) -> Column:
        return F.shiftright("key", KEY_BITS - bits)

    def before(window) -> Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    reached = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    totals = keyed.groupBy(leading(DIGIT).alias("prefix")).agg(F.sum("k").alias("n"))
    placed = totals.select("prefix", "n", before(Window.orderBy("prefix")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("size"))
    spots = [F.lit(p) * (F.col("size") - 1) for p in probs]
    slots = [
        F.struct(F.lit(2 * i + side).alias("slot"), rounding(spot).cast("bigint").alias("rank"))
        for i, spot in enumerate(spots)
        for side, rounding in enumerate((F.floor, F.ceil))
    ]
    wanted = placed.select("prefix", "before", "size", "n", F.inline(F.array(*slots))).where(reached)
    for bits in range(2 * DIGIT, KEY_BITS + 1, DIGIT):
        # Two ranks per probability, so the broadcast side has at most 2 * len(probs) rows.
        within = F.broadcast(wanted.select("slot", "rank", "size", F.col("before").alias("below"), F.col("prefix").alias("above")))
        inside = keyed.join(within, leading(bits - DIGIT) == F.col("above"))
        totals = inside.groupBy("slot", "rank", "size", "below", leading(bits).alias("prefix")).agg(F.sum("k").alias("n"), F.max("v").alias("v"))
        start = F.col("below") + before(Window.partitionBy("slot").orderBy("prefix"))
        wanted = totals.select("slot", "rank", "size", "prefix", "n", "v", start.alias("before")).where(reached)
    row = wanted.agg(
        F.max("size").alias("size"),
        *[F.max(F.when(F.col("slot") == s, F.col("v"))).cast("double").alias(f"s{s}") for s in range(2 * len(probs))]
    )

    def blend(i: int, p: float) -> Column:
        low, high = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        share = F.lit(p) * (F.col("size") - 1) - F.floor(F.lit(p) * (F.col("size") - 1))
        # Two equal infinities have no difference to share out.
        return F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share).alias(f"q{i}")

    return row.select(*[blend(i, p) for i, p in enumerate(probs)])


def _within(v: Column, first: Column, third: Column) -> Column:
    """Whether a value lies within 1.5 IQR of the quartiles."""
    reach = (third - first) * 1.5
    return (v >= first - reach) & (v <= third + reach)


def boxplot_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and the number of outliers; nulls and NaN are left out.

    Everything follows from the value counts, so the source is read once.
    """
    counts = value_counts(df, col)
    quartiles = exact_quantiles(counts, QUARTILES).select(F.struct("q0", "q1", "q2").alias("q")).scalar()
    v, k, q = F.col("v"), F.col("k"), F.col("q")
    inside = _within(v, q["q0"], q["q2"])
    # The subquery is attached once as a column; every direct mention would have to be reused.
    ends = counts.withColumn("q", quartiles).agg(
        F.coalesce(F.sum(k), F.lit(0)).alias("n"),
        *[F.max(q[f"q{i}"]).alias(f"q{i}") for i in range(3)],
        F.min(F.when(inside, v)).cast("double").alias("low"),
        F.max(F.when(inside, v)).cast("double").alias("high"),
        F.coalesce(F.sum(F.when(~inside, k)), F.lit(0)).alias("outliers"),
    )
    return ends.select(
        "n",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        F.least("low", "q0").alias("whisker_low"),
        F.greatest("high", "q2").alias("whisker_high"),
        "outliers",
    )


def boxplot_outliers(df: DataFrame, col: str) -> DataFrame:
    """The rows beyond the whiskers; nulls and NaN lie nowhere and are no outliers."""
    quartiles = exact_quantiles(value_counts(df, col), (0.25, 0.75)).select(F.struct("q0", "q1").alias("q")).scalar()
    return df.where(_present(df, col) & ~_within(F.col(col), quartiles["q0"], quartiles["q1"]))


def describe_engagement(df: DataFrame, col: str = "Upvotes") -> DataFrame:
    """Mean, exact median, sample standard deviation and sample variance; nulls and NaN are left out."""
    counts = value_counts(df, col)
    v, k = F.col("v").cast("double"), F.col("k")
    median = exact_quantiles(counts, (0.5,)).scalar()
    size = counts.agg(F.struct(F.sum("k").alias("n"), (F.sum(v * k) / F.sum(k)).alias("mean")).alias("s")).scalar()
    # Deviations from the known mean: sums of squares minus squared sums would lose all digits far from zero.
    spread = counts.withColumn("s", size).agg(
        F.max("s.mean").alias("mean"),
        F.when(F.max("s.n") > 1, F.sum(k * F.pow(v - F.col("s.mean"), F.lit(2.0))) / (F.max("s.n") - 1)).alias("variance"),
    )
    return spread.select("mean", median.alias("median"), F.sqrt("variance").alias("std"), "variance")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are kept.

    A single value is widened by half on each side. Both scans shuffle one row per task or per bin.
    """
    values = _values(df, col)
    ends = values.agg(
        F.coalesce(F.min("v").cast("double"), F.lit(0.0)).alias("low"),
        F.coalesce(F.max("v").cast("double"), F.lit(1.0)).alias("high"),
    )
    pad = F.when(F.col("low") == F.col("high"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = ends.select(F.struct((F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high")).alias("s")).scalar()
    low, high = F.col("s.low"), F.col("s.high")
    step = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, high).otherwise(low + i * step)

    v, guess = F.col("v").cast("double"), F.col("guess")
    # The division can land one bin off an edge; comparing with the edges themselves settles it.
    settled = (
        F.when(v < edge(guess), guess - 1)
        .when((v >= edge(guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    placed = values.withColumn("s", span).withColumn("guess", F.least(F.floor((v - low) / step), F.lit(bins - 1)).cast("int"))
    # At most one row per bin, so the broadcast is bounded by the parameter.
    filled = F.broadcast(placed.groupBy(settled.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").withColumn("s", span).select(
        "bin", edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density_curve(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian density at ``grid`` even points from minimum to maximum, Scott bandwidth.

    Evaluated per distinct value rather than per row, and only at the points that its kernel reaches: beyond them it is
    zero as a double. Summed inside each task per point; a point that no value reaches has density 0.
    Constant or single-row input has no bandwidth and gives no curve.
    """
    shape = _values(df, col).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.stddev_samp("v").alias("std"),
        F.min("v").cast("double").alias("low"),
        F.max("v").cast("double").alias("high"),
    )
    shape = shape.select(F.struct("n", "low", "high", (F.col("std") * F.pow("n", F.lit(-0.2))).alias("width")).alias("s")).scalar()
    v, k, width = F.col("v").cast("double"), F.col("k"), F.col("s.width")
    values = value_counts(df, col).withColumn("s", shape).where(width > 0)
    step, point = (F.col("s.high") - F.col("s.low")) / (grid - 1), F.col("point")
    from_low, reach = v - F.col("s.low"), F.lit(KERNEL_REACH) * width
    first = F.greatest(F.ceil((from_low - reach) / step), F.lit(0).cast("bigint"))
    last = F.least(F.floor((from_low + reach) / step), F.lit(grid - 1).cast("bigint"))
    # Infinite values have no steps to count, so theirs go to every point, which makes it NaN.
    every = F.isnan(width) | (first > last)
    within = F.sequence(F.when(every, F.lit(0).cast("bigint")).otherwise(first), F.when(every, F.lit(grid - 1).cast("bigint")).otherwise(last))
    x = F.col("s.low") + point * (F.col("s.high") - F.col("s.low")) / (grid - 1)
    z = (x - v) / width
    # At most one row per point, so the broadcast is bounded by the parameter.
    reached = F.broadcast(
        values.select("v", "k", "s", F.explode(within).alias("point")).groupBy("point").agg(F.sum(k * F.exp(-0.5 * z * z)).alias("kernel"))
    )
    points = df.sparkSession.range(grid).withColumnRenamed("id", "point").withColumn("s", shape).where(width > 0)
    height = F.coalesce("kernel", F.lit(0.0)) / (F.col("s.n") * width * F.sqrt(2 * F.pi()))
    return points.join(reached, "point", "left").select(point.cast("int").alias("point"), x.alias("x"), height.alias("density"))
