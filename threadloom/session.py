"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# The shuffle width is the caller's: about (shuffled bytes / 128 MB), rounded up generously, because
# adaptive execution merges small partitions up to the advisory size but cannot split a plain one.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture costs several round trips to the JVM per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "threadloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables, under the shared location the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="threadloom-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later result reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _listed(spark: SparkSession, path: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(system.listStatus(place)) if system.exists(place) else []


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if it does not exist."""
    return [s.getPath().getName() for s in _listed(spark, path) if s.isDirectory()]


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, none if it does not exist."""
    return [s.getPath().getName() for s in _listed(spark, path) if s.isFile()]


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all; fails if there is one already."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    place, draft = Path(path), Path(f"{path}-{uuid.uuid4().hex}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise FileExistsError(path)
