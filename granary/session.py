"""The session that tests, benchmark and examples use; on a cluster the caller brings its own."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch between Spark and Python, unless the session has settings of its own: with
#: the usual 10,000 rows, both sides hold tens of MB of text for each task, twice.
BATCH, BATCH_SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, USUAL_ROWS = 2000, "10000"
BATCH_BYTES, USUAL_BYTES = 16 << 20, "268435456"


class _Asked(threading.local):
    """Of each thread the shared folders that it asked for, by block of ``folders``."""

    def __init__(self):
        self.blocks: list[list[str]] = [[]]


_ASKED = _Asked()


def get_spark(cpus: str | int = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("granary")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str = "granary") -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, else under the warehouse.

    Only a session in one process (tests, benchmark) gets a temporary folder of this machine.
    """
    path = f"{_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _ASKED.blocks[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a shared folder: cuts the lineage, survives the loss of executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by its columns in as many parts as a shuffle of the session has, which are not joined afterwards.

    Spark joins parts by the bytes of their files; rows that compress well, or that a task makes many of, give tasks of some GB then.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by)


def bound_batches(df: DataFrame) -> None:
    """Give the session of ``df`` smaller Arrow batches than Spark's own, unless it has set bounds itself."""
    conf = df.sparkSession.conf
    for name, usual, ours in ((BATCH, USUAL_ROWS, BATCH_ROWS), (BATCH_SIZE, USUAL_BYTES, BATCH_BYTES)):
        if conf.get(name, usual) == usual:
            conf.set(name, str(ours))


@contextmanager
def folders() -> Iterator[list[str]]:
    """The list of shared folders that this thread asks for in the block; those of other threads are not in it."""
    mine: list[str] = []
    _ASKED.blocks.append(mine)
    try:
        yield mine
    finally:
        _ASKED.blocks.pop()
        _ASKED.blocks[-1].extend(mine)


def release(spark: SparkSession, paths: list[str], keep: tuple[str, ...] = ()) -> None:
    """Delete shared folders that ``folders`` listed, but those of ``keep``.

    For a caller that has written or collected what it wanted: tables still to be read must not rest on them.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    kept = {k.rstrip("/") for k in keep}
    for path in [f for f in paths if f not in kept]:
        p = hadoop(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        paths.remove(path)


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            base = _local_folder()
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return base


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """One temporary folder of this machine for a session in one process, gone at its end."""
    path = tempfile.mkdtemp(prefix="granary-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
