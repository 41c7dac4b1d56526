"""The content ledger as a stream: what was sent under a path and id before, in state of its own.

State is a map of ids for each path, in the state store: it survives restarts with the checkpoint, starts from cold entries if
some are given, forgets what it has not seen for a while if told to, and drops a path at a reset event. The text itself is
hashed before it gets there.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_ROW = ["p_order", "p_id", "p_h", "p_mtime", "p_run", "p_reset"]


def digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


class _Ledger(StatefulProcessor):
    """For each path a map from id to the hash, mtime and run of what was sent last; entries loaded at the start have no run."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = {} if self.keep_ms is None else {"ttlDurationMs": self.keep_ms}
        value = [StructField("h", StringType()), StructField("mtime", LongType()), StructField("run", LongType())]
        self.sent = handle.getMapState("sent", StructType([StructField("id", StringType())]), StructType(value), **kept)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for id, h, mtime in zip(initialState["p_id"], initialState["p_h"], initialState["p_mtime"], strict=True):
            self.sent.updateValue((id,), (h, int(mtime), -1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given: dict[str, list] = {c: [] for c in _ROW}
        for part in rows:
            for c, held in given.items():
                held += part[c].tolist()
        sent, changed, clear, out = {}, {}, False, ([], [], [])
        for order, id, h, mtime, run, reset in sorted(zip(*given.values(), strict=True), key=itemgetter(0)):
            if reset:
                sent, changed, clear = {}, {}, True
                continue
            if id in sent:
                last = sent[id]
            else:  # of each id the store is asked once, and told once below
                last = None if clear else self.sent.getValue((id,))
            if last is None or (last[0], last[1]) != (h, mtime):
                last = changed[id] = (h, int(mtime), int(run))
                state = "fresh"
            else:
                state = "already_sent" if last[2] == run else "cold"
            sent[id] = last
            for to, x in zip(out, (id, order, state), strict=True):
                to.append(x)
        if clear:
            self.sent.clear()
        for id, last in changed.items():
            self.sent.updateValue((id,), last)
        yield pd.DataFrame(dict(zip(("path", "id", "n", "state"), (key[0], *out), strict=True)), index=range(len(out[0])), columns=["path", "id", "n", "state"])

    def close(self) -> None:
        pass


def content_ledger(stream: DataFrame, path: str, id: str, order: str, text: str, mtime: str, run: str, reset: Column | None = None, cold: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """(path, id, n, state) of each sending: "fresh", "already_sent" in this run, or "cold" (known from an earlier one).

    ``run`` is a number of 0 or more; ``reset`` marks events that forget their path instead of sending; ``cold`` (path, id, h, mtime; h as
    by ``digest``) is what earlier processes left. With ``keep_ms`` an entry is forgotten that long after it was recorded (for running streams: one drained once must keep them, since time-outs start batches without end). Null texts are one content,
    null paths, ids and mtimes values like others ("" and -1). The session gets the state store that such state needs, if it has Spark's own.
    """
    conf = stream.sparkSession.conf
    if conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKSDB)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    rows = stream.select(word(path)("p_path"), word(id)("p_id"), F.col(order).cast("bigint").alias("p_order"), digest(F.col(text)).alias("p_h"), F.coalesce(F.col(mtime).cast("bigint"), F.lit(-1)).alias("p_mtime"), F.col(run).cast("bigint").alias("p_run"), (F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))).alias("p_reset"))
    start: GroupedData | None = None
    if cold is not None:
        start = cold.select(F.coalesce("path", F.lit("")).alias("p_path"), F.coalesce("id", F.lit("")).alias("p_id"), F.col("h").alias("p_h"), F.coalesce(F.col("mtime").cast("bigint"), F.lit(-1)).alias("p_mtime")).groupBy("p_path")
    return rows.groupBy("p_path").transformWithStateInPandas(_Ledger(keep_ms), "path string, id string, n bigint, state string", "append", "None" if keep_ms is None else "ProcessingTime", initialState=start)
