"""Streams: keyed ledgers, run deltas, call windows, sessions. State lives in the state store, with time-outs instead of caps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.session import shared_folder

#: How long a running stream keeps an idle key's state. A stream drained once must keep it for good:
#: with processing-time time-outs Spark starts batches without end.
KEEP_MS = 24 * 3600 * 1000


def _timeout(keep_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def read_ledger(stream: DataFrame, key: str, order: str, text: str, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Each reading of a key against the last one: (key, order, state) with full, unchanged or changed; a key's hash is kept ``keep_ms`` (None: for good)."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        pdf = pd.concat(list(parts)).sort_values(order)
        out = []
        for o, t in zip(pdf[order], pdf[text], strict=True):
            h = hashlib.sha256((t or "").encode()).hexdigest()
            out.append((k[0], o, "full" if last is None else "unchanged" if h == last else "changed"))
            last = h
        state.update((last,))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=[key, order, "state"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, state string", "h string", "append", _timeout(keep_ms))


def run_delta(stream: DataFrame, key: str, order: str, messages: str, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Runs of a key against the run before: (key, order, new, resolved, unchanged) as sorted arrays."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = set(state.get[0]) if state.exists else set()
        pdf = pd.concat(list(parts)).sort_values(order)
        out = []
        for o, m in zip(pdf[order], pdf[messages], strict=True):
            now = set(m if m is not None else ())
            out.append((k[0], o, sorted(now - before), sorted(before - now), sorted(now & before)))
            before = now
        state.update((sorted(before),))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=[key, order, "new", "resolved", "unchanged"])

    kinds = dict(stream.dtypes)
    lists = "new array<string>, resolved array<string>, unchanged array<string>"
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, {lists}", "last array<string>", "append", _timeout(keep_ms))


def timed(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp (a column without zone is not accepted), with a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def call_windows(stream: DataFrame, width: str = "1 hour", slide: str | None = None, ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Calls, errors and the sum of values for each kind and window."""
    at = F.window(ts, width, slide) if slide else F.window(ts, width)
    by = stream.groupBy(at.alias("w"), kind).agg(F.count("*").alias("calls"), F.count_if(F.col(kind) == "error").alias("errors"), F.sum(value).alias("total"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "calls", "errors", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    by = stream.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return by.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def once(stream: DataFrame, id: str = "event_id") -> DataFrame:
    """Each id once within the watermark."""
    return stream.dropDuplicatesWithinWatermark([id])


def with_dimension(stream: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """A stream joined with a static table, which is read anew for each batch; rows without a match stay."""
    return stream.join(table, on, "left")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is there and give its result as a table in the shared folder (each run has its own)."""
    spark = stream.sparkSession
    path = shared_folder(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    else:
        # complete and update modes give whole results: the last batch's is the table
        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
