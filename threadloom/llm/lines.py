"""Line deduplication over windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import text_key, unused

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """One row per window that is not blank: document (doc_id, t1, t2), pos of its first line, hashes w1 and w2."""
    t1, t2 = text_key(F.col("text"))
    base = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), _lines(F.col("text")).alias("lines"))

    def window(i: Column) -> Column:
        part = F.slice("lines", i + 1, width)
        return F.struct(
            i.alias("pos"), F.xxhash64(part).alias("w1"), F.xxhash64(F.lit("second"), part).alias("w2"),
            F.exists(part, lambda line: F.trim(line) != "").alias("some"),
        )

    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size("lines") - width, F.lit(0))), window)
    return base.select("doc_id", "t1", "t2", F.inline(every)).where("some").drop("some")


def dedup_lines(docs: DataFrame, width: int = WINDOW, removed: str | None = None) -> DataFrame:
    """``docs`` with every later occurrence of a window of ``width`` consecutive lines taken out of ``text``.

    Occurrences are ordered by doc_id, a hash of the text and position; the first stays. What later ones cover
    is merged and removed, so each different line stays where it occurs first. A text of fewer lines is one
    window of its own. Blank windows never count. All rows and columns stay; ``removed`` names a column to add
    with the number of lines taken out. A text that loses all lines becomes empty, one that loses none is left
    as it is, null too. Null ids come first. Rows that share id and text count as one document. Hashes have 128
    bits. Windows are counted before the shuffle, and a window is joined with one row for its first occurrence.
    """
    windows = _windows(docs, width)
    place = F.struct("doc_id", "t1", "t2", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2", "first")
    later = windows.join(first, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("at"))

    id_, t1, t2, at, lines, n = unused(docs, "_id", "_t1", "_t2", "_at", "_lines", "_removed")
    covered = covered.select(F.col("doc_id").alias(id_), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("at").alias(at))
    key1, key2 = text_key(F.col("text"))
    joined = docs.join(covered, F.col("doc_id").eqNullSafe(F.col(id_)) & (key1 == F.col(t1)) & (key2 == F.col(t2)), "left")
    split = joined.withColumn(lines, _lines(F.col("text")))
    last = F.size(lines) - 1
    gone = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, F.least(p + width - 1, last)))))
    kept = F.array_except(F.sequence(F.lit(0), last), gone)
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    out = split.withColumns({"text": text, n: F.coalesce(F.size(gone), F.lit(0))})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.col(n).alias(removed)] if removed else []))
