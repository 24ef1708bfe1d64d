"""Stored posts and comments tables, and the append that skips what is already stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import empty_if_null, null_if_empty
from threadloom.operators.keyed import Order, first_per_key, is_blank
from threadloom.schema import COMMENTS_COLUMNS, POSITION, POSTS_COLUMNS
from threadloom.session import drop_scratch, files, folders, put_file

STUDY = "Study_ID"
VERSION, COMMITS = "version", "_commits"


def write_corpus(posts: DataFrame, comments: DataFrame, path: str, mode: str = "errorifexists", compact: bool = False) -> None:
    """Write both tables, one folder per study where the study is known, and then make them the corpus.

    Each call writes folders of its own. A small commit file, renamed into place when both tables are complete, lists the
    folders that are the corpus from then on: the new ones alone (``overwrite``) or with the earlier ones (``append``).
    A reader therefore sees both tables of one commit, and a job that fails in between changes nothing. ``compact``
    spends a shuffle to even out file sizes; the rebalance hint splits a dominant study over many tasks instead of
    sending it to one.
    """
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode: {mode}")
    spark = posts.sparkSession
    number, earlier = _commit(spark, path)
    if mode == "errorifexists" and (number or folders(spark, path)):
        raise FileExistsError(f"a corpus exists already: {path}")
    if mode == "append" and not number and folders(spark, path):
        raise ValueError("a corpus without commits cannot be appended to; write it anew")
    version = uuid.uuid4().hex
    for name, table in (("posts", posts), ("comments", comments)):
        parts = [STUDY] if STUDY in table.columns else []
        if compact:
            table = table.hint("rebalance", *parts)
        (table.write.partitionBy(*parts) if parts else table.write).parquet(f"{path}/{name}/{VERSION}={version}")
    put_file(spark, f"{path}/{COMMITS}/{number + 1}", "\n".join([*(earlier if mode == "append" else []), version]))


def _commit(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the last commit, 0 without any, and the versions that it lists."""
    numbers = [int(name) for name in files(spark, f"{path}/{COMMITS}") if name.isdigit()]
    if not numbers:
        return 0, []
    rows = spark.read.text(f"{path}/{COMMITS}/{max(numbers)}").collect()
    return max(numbers), [row[0] for row in rows]


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Remove the folders that the last commit does not list, such as those of failed jobs; gives their number.

    Not while a job writes to this corpus or still reads an earlier commit.
    """
    _, kept = _commit(spark, path)
    old = [f"{path}/{t}/{f}" for t in ("posts", "comments") for f in folders(spark, f"{path}/{t}") if f.removeprefix(f"{VERSION}=") not in kept]
    for folder in old if kept else []:
        drop_scratch(spark, folder)
    return len(old) if kept else 0


def read_corpus(spark: SparkSession, path: str, study_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables of the last commit with their published columns; a study id prunes to that study's folders.

    A folder without commits is read as one pair of tables.
    """
    _, versions = _commit(spark, path)
    tables = []
    for name, columns in (("posts", list(POSTS_COLUMNS)), ("comments", COMMENTS_COLUMNS)):
        places = [f"{path}/{name}/{VERSION}={v}" for v in versions] or [f"{path}/{name}"]
        reader = spark.read.option("basePath", f"{path}/{name}")
        table = reader.parquet(*places)
        if STUDY in table.columns:
            # Folder names are typed on read, and 007 or 1e5 would come back as other numbers.
            typed = T.StructType([T.StructField(f.name, T.StringType() if f.name == STUDY else f.dataType) for f in table.schema])
            table = reader.schema(typed).parquet(*places)
            if study_id is not None:
                table = table.where(F.col(STUDY) == study_id)
        tables.append(table.select(*columns))
    return tables[0], tables[1]


def normalize_nulls(df: DataFrame, mode: str) -> DataFrame:
    """Text columns under one of the two null rules: "coalesce" (null is "") or "strict" ("" is null)."""
    rule = {"coalesce": empty_if_null, "strict": null_if_empty}[mode]
    return df.withColumns({name: rule(F.col(name)) for name, dtype in df.dtypes if dtype == "string"})


def append_new(incoming: DataFrame, stored: DataFrame, key: str = "id", order: Order = POSITION, small_incoming: bool = False) -> DataFrame:
    """Incoming rows to add: unseen ids, first copy only, and every row whose id is null or empty.

    Incoming rows are read and shuffled once: a row without an id is ranked under a number of its own, so it
    competes with none, whatever its order values, and such rows spread over all tasks. Copies are reduced before the join, which
    reuses the partitioning of that ranking. With ``small_incoming``, set only by a caller that has
    measured the batch, its ids are broadcast and the stored ids are never shuffled whole.
    """
    number = F.monotonically_increasing_id().cast("string")
    slot = F.when(is_blank(key), F.concat(F.lit("row "), number)).otherwise(F.concat(F.lit("id "), F.col(key)))
    known = stored.where(~is_blank(key)).select(key)
    if small_incoming:
        known = known.join(F.broadcast(incoming.where(~is_blank(key)).select(key).distinct()), key, "left_semi")
    # Distinct first: an id stored many times is folded inside its tasks, not shuffled whole.
    seen = known.select(F.concat(F.lit("id "), F.col(key)).alias("_slot")).distinct()
    fresh = first_per_key(incoming.withColumn("_slot", slot), "_slot", order).join(seen, "_slot", "left_anti")
    return fresh.select(*incoming.columns)
