"""Raw discussion records: JSON lines in, one row per post out, comments kept nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.counts import json_integer
from threadloom.functions.text import stripped
from threadloom.params import check_study_id
from threadloom.schema import COMMENT_TYPE, COMMENTS_TYPE, POSITION, RAW_POST_TYPES

# Scalars are taken as text first so that a wrong type spoils one field, not the whole record.
_POST_TEXT = T.StructType([T.StructField(name, T.StringType()) for name in RAW_POST_TYPES])
_COMMENT_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in COMMENT_TYPE])
_LINE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("post", _POST_TEXT),
            T.StructField("comments", T.ArrayType(T.StringType())),
            T.StructField("line_end", T.BooleanType()),
        ]
    )
)
_STRICT = {"allowSingleQuotes": "false"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their input order: file path, then block, then row."""
    return positioned(spark.read.text(path))


def positioned(lines: DataFrame) -> DataFrame:
    """Add the input-order column; needs a frame straight from a file scan."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("value", place.alias(POSITION))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Decode the non-blank lines; ``decoded`` is null where a line is not one JSON object.

    The line is parsed as the first element of an array closed by a marker element. The parser
    ignores whatever follows a complete value, so without the marker a line with trailing content
    or an early close would pass as valid.
    """
    wrapped = F.concat(F.lit("["), F.col(line), F.lit(',{"line_end":true}]'))
    # The lambda names the parse result so that testing and taking it cost one parse, and the
    # generator keeps later filters from repeating it below.
    parsed = F.transform(
        F.array(F.from_json(wrapped, _LINE_TYPE, _STRICT)),
        lambda e: F.when((F.size(e) == 2) & F.get(e, F.lit(1))["line_end"], F.get(e, F.lit(0))),
    )
    filled = lines.where(stripped(F.col(line)) != "")
    return filled.select("*", F.explode_outer(parsed).alias("decoded")).withColumnRenamed(line, "raw")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split decoded lines into flat records and the rejected lines with their place."""
    good = flatten(parsed.where(F.col("decoded").isNotNull()))
    bad = parsed.where(F.col("decoded").isNull()).drop("decoded")
    return good, bad


def number_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``line``, the 1-based number within its file, to some of the positioned ``lines``.

    A file may be cut into many blocks that are read apart. The lines of every block are counted, blank ones too, and a
    line's number is the sum over the blocks before it plus its place in its own. That takes one more reading of the
    text, without parsing it, and a table with one row per block.
    """
    place = F.col(POSITION)
    keys = [place["file"].alias("_file"), place["block"].alias("_block")]
    blocks = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(place["row"]).alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = blocks.select("_file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    found = rows.join(starts, (place["file"] == F.col("_file")) & (place["block"] == F.col("_block")))
    return found.withColumn("line", place["row"] + F.col("_shift")).drop("_file", "_block", "_shift")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """file, line, raw of every positioned line that is neither blank nor a record."""
    bad = quarantine(parse_lines(lines))[1]
    return number_lines(bad, lines).select(F.col(POSITION)["file"].alias("file"), "line", "raw")


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of every readable line under ``path``; see ``quarantine`` for the others."""
    return quarantine(parse_lines(read_lines(spark, path)))[0]


def flatten(parsed: DataFrame) -> DataFrame:
    """Post fields as columns next to the typed comment array."""
    post, comments = F.col("decoded.post"), F.col("decoded.comments")
    fields = [
        (json_integer(post[name]) if isinstance(dtype, T.LongType) else post[name]).alias(name)
        for name, dtype in RAW_POST_TYPES.items()
    ]
    keep = [c for c in parsed.columns if c not in ("raw", "decoded")]
    return parsed.select(*fields, _comments(comments).alias("comments"), *keep)


def _comments(texts: Column) -> Column:
    """Typed comments; an element that is no JSON object stays in the list as a null."""
    raw = F.transform(texts, lambda t: F.when(F.ltrim(t).startswith("{"), F.from_json(t, _COMMENT_TEXT, _STRICT)))
    typed = F.transform(
        raw,
        lambda c: F.when(
            c.isNotNull(),
            F.struct(c["author"].alias("author"), c["body"].alias("body"), json_integer(c["upvotes"]).alias("upvotes")),
        ),
    )
    return F.coalesce(typed, F.array().cast(COMMENTS_TYPE))


def conform(df: DataFrame) -> DataFrame:
    """Add missing record columns as nulls and turn absent or non-list comments into an empty list."""
    present = dict(df.dtypes)
    missing = {n: F.lit(None).cast(t) for n, t in RAW_POST_TYPES.items() if n not in present}
    empty = F.array().cast(COMMENTS_TYPE)
    is_list = present.get("comments", "").startswith("array")
    return df.withColumns({**missing, "comments": F.coalesce("comments", empty) if is_list else empty})


def stamp_study(df: DataFrame, study_id: str, theme_label: str) -> DataFrame:
    """Mark every record with the study it belongs to."""
    return df.withColumns({"study_id": F.lit(check_study_id(study_id)), "theme_label": F.lit(theme_label)})


def to_json_lines(records: DataFrame) -> DataFrame:
    """One ``value`` column holding each record as the nested JSON line it is stored as."""
    post = F.struct(*[n for n in RAW_POST_TYPES if n in records.columns])
    return records.select(F.to_json(F.struct(post.alias("post"), "comments"), {"ignoreNullFields": "false"}).alias("value"))
