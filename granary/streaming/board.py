"""The dashboard of a stream of calls, kept as small tables that a batch replayed changes nothing in.

Batch n writes version n from the newest version before n and its own rows, so writing it again gives the same. The two newest
versions stay; a reader takes the newest that was written to its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how many of the latest calls are shown.
RECENT = 500
TOTALS = "tool string, calls bigint, errors bigint, duration_ms bigint, tokens bigint"
CALLS = "at bigint, id bigint, tool string, success boolean, duration_ms bigint, token_count bigint"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    made = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(made(f"{path}/{n}/recent/_SUCCESS")))


def _state(spark: SparkSession, path: str, version: int | None) -> tuple[DataFrame, DataFrame]:
    if version is None:
        return spark.createDataFrame([], TOTALS), spark.createDataFrame([], CALLS)
    return spark.read.schema(TOTALS).parquet(f"{path}/v={version}/totals"), spark.read.schema(CALLS).parquet(f"{path}/v={version}/recent")


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls with rows (at, id, tool, success, duration_ms, token_count) and the batch's number."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < n]
        totals, recent = _state(spark, path, before[-1] if before else None)
        calls = batch.select("at", "id", "tool", "success", "duration_ms", "token_count")
        fresh = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.sum("duration_ms").alias("duration_ms"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
        summed = totals.unionByName(fresh).groupBy("tool").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("calls", "errors", "duration_ms", "tokens")])
        summed.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={n}/totals")  # a row a tool
        last = recent.unionByName(calls).orderBy(F.col("at").desc(), F.col("id").desc()).limit(RECENT)
        last.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={n}/recent")
        for old in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return merge


def record(stream: DataFrame, path: str, checkpoint: str):
    """Start keeping the board of a stream of calls; everything there, then it stops."""
    return stream.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(by tool with mean duration and tokens saved, the busiest first; the latest calls, oldest first) of the newest version."""
    from granary.operators.stats import SAVED

    versions = _versions(spark, path)
    totals, recent = _state(spark, path, versions[-1] if versions else None)
    by = totals.select("tool", "calls", "errors", F.expr("duration_ms div calls").alias("avg_ms"), "tokens", F.expr(f"tokens * {SAVED} div 100").alias("tokens_saved"))
    return by.orderBy(F.col("calls").desc(), "tool"), recent.orderBy("at", "id")
