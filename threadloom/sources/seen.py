"""The ids a store holds, kept beside it by hash bucket, so that a batch looks only where its ids could be.

Every batch adds one run, a folder with one small file per bucket that it touched. Runs of one level are merged into
one of the next when there are enough of them, so a store of n batches has about log n levels and every id is
rewritten that often. A run is complete before the runs it replaces go; a crash in between leaves ids twice, which
changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.keyed import is_blank
from threadloom.session import drop_scratch, folders

BUCKETS = 64
FAN = 8
STREAM, BATCH, BUCKET, RUN = "stream", "batch", "bucket", "run"
_ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())])


@dataclass(frozen=True)
class SeenIds:
    """An index under ``path``; an index with another number of ``buckets`` is another one."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    fan: int = FAN

    @property
    def root(self) -> str:
        return f"{self.path.rstrip('/')}/of-{self.buckets}"

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def runs(self) -> list[str]:
        return sorted(name.removeprefix(f"{RUN}=") for name in folders(self.spark, self.root))

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """(id, stream, batch) of the whole index, or of some buckets: only their folders are scanned."""
        if not self.runs():
            return self.spark.createDataFrame([], _ROW)
        rows = self._rows()
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(*sorted(buckets)))
        return rows.select(*_ROW.fieldNames())

    def _rows(self) -> DataFrame:
        folder = [T.StructField(RUN, T.StringType()), T.StructField(BUCKET, T.IntegerType())]
        return self.spark.read.schema(T.StructType([*_ROW.fields, *folder])).parquet(self.root)

    def add(self, ids: DataFrame, stream: str, batch: int) -> None:
        """Add the ids of one batch, in place of what an earlier attempt at it added; blank ids are never seen."""
        rows = ids.where(~is_blank("id")).select("id", F.lit(stream).alias(STREAM), F.lit(batch).cast("long").alias(BATCH))
        self._write(rows, f"0-{stream}-{batch}")

    def build(self, stored: DataFrame) -> None:
        """Start an index from the rows (id, stream, batch) of a store that has none."""
        self._write(stored.where(~is_blank("id")).select("id", STREAM, F.col(BATCH).cast("long").alias(BATCH)), "1-start")

    def _write(self, rows: DataFrame, run: str) -> None:
        keyed = rows.withColumn(BUCKET, self.bucket(F.col("id")))
        keyed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{RUN}={run}")

    def merge(self, spare: str | None = None) -> None:
        """Merge levels that have ``fan`` runs; the run named ``spare`` may still be replaced and stays."""
        levels: dict[int, list[str]] = {}
        for run in self.runs():
            if run != spare:
                levels.setdefault(int(run.split("-")[0]), []).append(run)
        for level, runs in levels.items():
            if len(runs) >= self.fan:
                merged = self._rows().where(F.col(RUN).isin(*runs)).select(*_ROW.fieldNames())
                self._write(merged, f"{level + 1}-{uuid.uuid4().hex}")
                for run in runs:
                    drop_scratch(self.spark, f"{self.root}/{RUN}={run}")
