"""Incremental collection as a stream of arriving JSON-lines files."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.keyed import is_blank
from threadloom.schema import POSITION, RECORD_SCHEMA
from threadloom.sources.corpus import append_new
from threadloom.sources.records import number_lines, parse_lines, positioned, quarantine
from threadloom.sources.seen import BUCKETS, FAN, SeenIds

STREAM, BATCH = "stream", "batch"
STORE_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())])
REJECT_SCHEMA = T.StructType([T.StructField("raw", T.StringType()), T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("line", T.LongType())])

# A batch broadcasts its ids when their measured size, with this much overhead per row, stays
# under the limit; otherwise the lookup among the stored ids is an ordinary shuffled join.
BROADCAST_BYTES = 128 * 1024 * 1024
ROW_OVERHEAD = 64


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Every record appended so far."""
    return _stored(spark, store).select(*RECORD_SCHEMA.fieldNames())


def rejects_of(store: str) -> str:
    return f"{store.rstrip('/')}_rejects"


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """Every line that was no record, with its file, block and number in the file (null in folders of older versions)."""
    schema = T.StructType([*REJECT_SCHEMA.fields, T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())])
    return spark.read.schema(schema).parquet(rejects).select(*REJECT_SCHEMA.fieldNames())


def ids_of(store: str) -> str:
    return f"{store.rstrip('/')}_ids"


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(store)


def _stream_key(spark: SparkSession, checkpoint: str) -> str:
    """Identity that lives and dies with the checkpoint, so a fresh one never reuses batch folders."""
    place = f"{checkpoint}/store_key"
    try:
        known = spark.read.text(place).first()
    except AnalysisException:
        known = None
    if known:
        return known[0]
    key = uuid.uuid4().hex
    spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").text(place)
    return key


def append_new_stream(
    spark: SparkSession, source: str, store: str, checkpoint: str, max_files: int | None = None, every: str | None = None,
    rejects: str | None = None, buckets: int = BUCKETS, fan: int = FAN,
) -> StreamingQuery:
    """Append the new posts of every file arriving under ``source``.

    Without ``every`` the query ends when caught up; with an interval such as "1 minute" it keeps
    watching the folder.

    Each micro-batch owns one folder of the store and one run of the id index (``<store>_ids``), and replaces both when
    it is replayed after a failure. It compares itself with the index, in the buckets its own ids fall into, but for
    what an earlier attempt at it added. A replay therefore neither repeats nor loses rows, including those without an
    id, and the work of a batch does not grow with what is stored in other buckets. A store without index gets one. Lines that are no records go to a folder of
    their own per batch, under ``rejects`` (``<store>_rejects`` by default), replaced in the same way.
    """
    key = _stream_key(spark, checkpoint)
    spark.createDataFrame([], RECORD_SCHEMA).write.mode("ignore").parquet(f"{store}/{STREAM}=none/{BATCH}=0")
    bad = rejects or rejects_of(store)
    spark.createDataFrame([], REJECT_SCHEMA).write.mode("ignore").parquet(f"{bad}/{STREAM}=none/{BATCH}=0")
    seen = SeenIds(spark, ids_of(store), buckets, fan)
    if not seen.runs():
        seen.build(_stored(spark, store).where(F.col(STREAM) != "none"))
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arriving = reader.load(source).select("value", "_metadata")
    return (
        arriving.writeStream.foreachBatch(lambda lines, batch: _save_batch(lines, batch, store, key, rejects or rejects_of(store), seen))
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def append_new_state(spark: SparkSession, source: str, store: str, checkpoint: str, max_files: int | None = None, every: str | None = None) -> StreamingQuery:
    """Append the new posts of every file arriving under ``source``, with the ids kept in Spark's state store.

    One record of each id is kept for as long as the checkpoint lives, whichever of a batch's copies comes first; records
    with a null or empty id are all kept and never enter the state. The state holds every id, so choose the RocksDB
    provider (``spark.sql.streaming.stateStore.providerClass``) where ids outgrow the executors' memory. Unlike
    ``append_new_stream`` it knows nothing of what else the store holds: all of the store comes from this query, and
    its files are the file sink's, which commits each batch once. Lines that are no records are left out.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    records = quarantine(parse_lines(reader.load(source).select("value")))[0].select(*RECORD_SCHEMA.fieldNames())
    new = records.where(~is_blank("id")).dropDuplicates(["id"]).unionByName(records.where(is_blank("id")))
    return (
        new.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def read_state_store(spark: SparkSession, store: str) -> DataFrame:
    """Every record that ``append_new_state`` has committed."""
    return spark.read.schema(RECORD_SCHEMA).parquet(store)


def _save_batch(lines: DataFrame, batch: int, store: str, key: str, rejects: str, seen: SeenIds | None = None) -> None:
    seen = seen or SeenIds(lines.sparkSession, ids_of(store))
    placed = positioned(lines)
    records, bad = quarantine(parse_lines(placed))
    place = F.col(POSITION)
    numbered = number_lines(bad, placed)
    numbered.select("raw", place["file"].alias("file"), place["block"].alias("block"), "line").write.mode("overwrite").parquet(
        f"{rejects}/{STREAM}={key}/{BATCH}={batch}"
    )
    records = records.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size, touched = records.agg(
            F.coalesce(F.sum(F.octet_length("id") + ROW_OVERHEAD), F.lit(0)), F.collect_set(seen.bucket(F.col("id")))
        ).first()
        earlier = seen.read(touched).where((F.col(STREAM) != key) | (F.col(BATCH) != batch))
        fresh = append_new(records, earlier, small_incoming=size <= BROADCAST_BYTES)
        folder = f"{store}/{STREAM}={key}/{BATCH}={batch}"
        fresh.select(*RECORD_SCHEMA.fieldNames()).write.mode("overwrite").parquet(folder)
        seen.add(lines.sparkSession.read.schema(RECORD_SCHEMA).parquet(folder), key, batch)
        # Earlier batches are committed, so their runs may be merged; this one may come again.
        seen.merge(spare=f"0-{key}-{batch}")
    finally:
        records.unpersist()
