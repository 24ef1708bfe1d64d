"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The rows written once to the shared scratch folder and read back, so that later steps do not redo them."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local(df: DataFrame) -> pd.DataFrame:
    """A small table on the driver; columns, not row objects, whatever the session's settings."""
    return df.toArrow().to_pandas()


def text_slices(texts: Sequence[str | None], chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """The texts of a batch, about ``chars`` characters at a time, as rows and strings.

    A longer text is cut into several parts, each before white space; a part without any is not cut. Nulls and
    empty texts are left out.
    """
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        begin, end = 0, len(text) if text else 0
        while begin < end:
            stop = min(begin + chars, end)
            while stop < end and not text[stop].isspace():
                stop += 1
            rows.append(row)
            parts.append(text[begin:stop] if stop - begin < end else text)
            size += stop - begin
            begin = stop
            if size >= chars:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def in_fold(doc_id: str, folds: int) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by ``folds``; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == 1, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have, whatever their case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text; a null text counts as the empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
