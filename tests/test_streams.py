"""Streams with state of their own against the same computation in one batch, over restarts and replays."""

import random

from pyspark.sql import functions as F

from granary.operators import delta, stats
from granary.streaming import board, content

SENT = "path string, id string, n bigint, text string, mtime bigint, run bigint, reset boolean"


def sendings(seed: int, n: int):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), i, rng.choice(["one", "two", None]), rng.choice([1, 1, 1, 2]), i // 40, False) for i in range(n)]


def streamed(spark, folder, **kw):
    s = spark.readStream.schema(SENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = content.content_ledger(s, "path", "id", "n", "text", "mtime", "run", reset=F.col("reset"), **kw)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=lambda r: r[2])


def put(spark, folder, rows):
    spark.createDataFrame(rows, SENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_ledger_equals_batch_after_a_restart(spark, tmp_path):
    rows = sendings(1, 120)
    for part in (rows[:50], rows[50:70]):
        put(spark, tmp_path, part)
    streamed(spark, tmp_path)
    put(spark, tmp_path, rows[70:])
    got = streamed(spark, tmp_path)
    df = spark.createDataFrame(rows, SENT).withColumn("path", F.coalesce("path", F.lit("")))
    want = delta.content_ledger(df, ["path", "id"], "n", "text", "mtime", "run")
    assert got == sorted(map(tuple, want.collect()), key=lambda r: r[2])
    assert {s for *_, s in got} == {"fresh", "already_sent", "cold"}


def test_ledger_starts_from_cold_entries_and_is_reset(spark, tmp_path):
    cold = spark.createDataFrame([("a", "x", "one", 1)], "path string, id string, text string, mtime bigint").select("path", "id", content.digest(F.col("text")).alias("h"), "mtime")
    put(spark, tmp_path, [("a", "x", 1, "one", 1, 0, False), ("a", "x", 2, "one", 1, 0, False), ("a", "y", 3, "one", 1, 0, False), ("a", "y", 4, "one", 1, 0, False), ("a", None, 5, None, None, 0, True), ("a", "x", 6, "one", 1, 0, False), ("b", "x", 7, "one", 1, 0, False)])
    got = streamed(spark, tmp_path, cold=cold)
    assert [(n, s) for _, _, n, s in got] == [(1, "cold"), (2, "cold"), (3, "fresh"), (4, "already_sent"), (6, "fresh"), (7, "fresh")]


def test_board_equals_batch_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i // 3, i, rng.choice(["read", "find", "edit"]), rng.random() < 0.8, rng.randint(0, 99), rng.choice([None, 5, 700])) for i in range(1300)]
    batches = [spark.createDataFrame(rows[a : a + 325], board.CALLS) for a in range(0, 1300, 325)]
    merge = board.merge_into(str(tmp_path / "board"))

    def shown():
        return [list(map(tuple, x.collect())) for x in board.snapshot(spark, str(tmp_path / "board"))]

    assert shown() == [[], []]
    for n, batch in enumerate(batches):
        merge(batch, n)
    first = shown()
    merge(batches[-1], 3)
    assert shown() == first
    assert first[1] == rows[-500:]
    whole = spark.createDataFrame(rows, board.CALLS)
    assert first[0] == [tuple(r) for r in stats.dashboard(whole.withColumn("token_count", F.coalesce("token_count", F.lit(0)))).select("tool", "calls", "errors", "avg_ms", "tokens", "tokens_saved").collect()]
    assert len([x for x in (tmp_path / "board").iterdir() if x.name.startswith("v=")]) == 2


def test_ledger_asks_its_state_once_an_id(monkeypatch):
    import pandas as pd

    class Sent(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        containsKey = lambda self, key: key in self

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    ledger = content._Ledger(None)
    ledger.sent = Sent({("x",): ("h0", 1, 0)})
    part = lambda a, b: pd.DataFrame([(i, "xy"[i % 2], f"h{i // 500 % 2}", 1, i // 300, False) for i in range(a, b)], columns=["p_order", "p_id", "p_h", "p_mtime", "p_run", "p_reset"])
    (out,) = ledger.handleInputRows(("p",), iter([part(500, 1200), part(0, 500)]), None)
    assert ledger.sent.calls == 4 and out["n"].tolist() == list(range(1200)) and set(out["path"]) == {"p"}
    assert out["state"].tolist() == [("fresh" if i in (1, 500, 501, 1000, 1001) else "already_sent" if i // 300 == (0 if i < 500 else 1 if i < 1000 else 3) else "cold") for i in range(1200)]
    assert ledger.sent == {("x",): ("h0", 1, 3), ("y",): ("h0", 1, 3)}
