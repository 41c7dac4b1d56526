"""Joins and texts that stay spread: plans without broadcasts or second readings, and the same rows by brute force."""

import random
import re

from granary.operators import analyses, history, relations
from granary.plans import programs, registry, reports
from granary.plans.reports import listed
from granary.session import BATCH, BATCH_BYTES, BATCH_ROWS, BATCH_SIZE
from granary.sources import extract
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_joined_to_few_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    out = listed(df, ["k"], ["id"], F.col("id").cast("string"))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.k, r.text) for r in out.collect()) == [(k, "\n".join(str(k + 100 * i) for i in range(10))) for k in range(100)]


def test_frames_meet_their_source_without_a_broadcast(spark):
    frames = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 3), (1, 2, "b", 2), (2, 0, None, 5), (2, 1, "a", None), (None, 0, "a", 99)], "f bigint, n bigint, file string, line bigint")
    lines = spark.createDataFrame([("a", i, f"x{i}") for i in range(1, 6)], "file string, line_no int, line string")
    out = analyses.frames_with_source(frames, lines, ["f"], 1)
    assert "Broadcast" not in plan(out)
    got = {(r.f, r.n): r.source for r in out.collect()}
    assert got == {(1, 0): "> 1: x1\n  2: x2", (1, 1): "  2: x2\n> 3: x3\n  4: x4", (1, 2): None, (2, 0): None, (2, 1): None, (None, 0): None}


def test_coverage_by_blocks_equals_line_by_line(spark):
    rng = random.Random(7)
    hits = [(rng.choice("ab"), rng.randint(1, 400), rng.random() < 0.5) for _ in range(600)] + [("a", 70, None)]
    asked = [(rng.choice("abc"), f"s{i}", a := rng.randint(1, 400), a + rng.choice([-3, 0, 5, 63, 64, 200])) for i in range(60)]
    out = relations.coverage(spark.createDataFrame(hits, "file string, line_no bigint, hit boolean"), spark.createDataFrame(asked + asked[:3], "file string, name string, start bigint, end bigint"))
    assert "Broadcast" not in plan(out) and plan(out).count("Join") == 1
    got = {(r.file, r.name, r.start, r.end): (r.covered, r.total) for r in out.collect()}
    within = lambda f, a, b: [h for g, n, h in hits if g == f and a <= n <= b]
    assert got == {(f, n, a, b): (sum(h is True for h in within(f, a, b)), len(within(f, a, b))) for f, n, a, b in asked}


def test_blame_is_read_once(spark):
    a, b = "a" * 40, "b" * 40
    text = [f"{a} 1 1 1", "author x", "author-time 86400", "\tone", f"{b} 1 2 1", "author y", "\tauthor z", f"{a} 2 3 1", "\tthree"]
    out = history.parse_blame(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "\tnone")], "blame bigint, line_no bigint, line string"))
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a" * 7, "x", "1970-01-02", "one"), (1, 2, "b" * 7, "y", None, "author z"), (1, 3, "a" * 7, "x", "1970-01-02", "three")]


def test_diffs_are_read_once(spark):
    text = ["x", "diff --git a/p b/p", "new file mode 1", "@@ -1 +1 @@ fn f()", "+a", "-b", "@@ -9 +9 @@ fn g()", "+c", "diff --git a/q b/q", "@@ -1 +1 @@ fn f()", "-d"]
    out = history.structural_diff(history.parse_diff(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "diff bigint, line_no bigint, line string")))
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "p", "added", "fn f()", 1, 1, 1), (1, "p", "added", "fn g()", 1, 1, 0), (1, "q", "modified", "fn f()", 1, 0, 1)]


def test_programs_stay_spread_behind_their_window(spark, sf):
    for files in (reports._program(spark, sf), programs._ring(spark, sf)):
        assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and "AQEShuffleRead" not in plan(files)


def test_rounds_of_reached_nodes_are_written(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(2, 0)], "caller int, callee int")
    out = relations.reachable(edges, edges.where("caller = 0").select(F.col("caller").alias("node")), 5)
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(i, i) for i in range(6)]


def test_lines_are_joined_without_a_formatter(spark, sf):
    for name in ("diagnostics_mypy", "diagnostics_pyright", "diagnostics_tsc", "diagnostics_govet", "diagnostics_cargo"):
        assert "format_string" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame([(1, "a", -7), (None, None, 2**40)], "a int, b string, c bigint")
    for pattern, values in (("%d:%s", ("a", "b")), ("", ()), ("x%dy\n%d", (F.col("c") % 3, "c")), ('{"%s"}', ("b",)), ("100%% of %d", ("a",)), ("%05d", ("c",))):
        assert df.select(reports.put(pattern, *values)).collect() == df.select(F.format_string(pattern, *values)).collect()


def test_codes_at_the_end_of_a_line_of_mypy():
    old = re.compile(r"(.*?)(?:\s+\[([\w-]+)\])?$")
    for said in ("a", "a [b]", "a  \t[b-c]", "a[b]", "a [b] [c]", " [b]", "[b]", "a []", "a [b c]", "a [b]]", "a [[b]", "list [int] is", "a [é]", "]", ""):
        line = f"x.py:3: error: {said}".strip()
        got = extract.diagnostics("mypy")(line)
        m = re.match(r"([^:\s]+):(\d+):(?:(\d+):)? (error|warning|note): " + old.pattern, line)
        assert got == ([(m[1], 3, 0, "error", m[6], m[5])] if m else [])


def test_parsers_take_small_batches_unless_the_session_has_its_own(spark):
    df = spark.createDataFrame([("a=1",)], "text string")
    spark.conf.unset(BATCH_SIZE)
    for own, want in ((None, str(BATCH_ROWS)), ("77", "77")):
        spark.conf.set(BATCH, own) if own else spark.conf.unset(BATCH)
        extract.rows_of(df, [], "text", extract.env, extract.ENV)
        assert (spark.conf.get(BATCH), spark.conf.get(BATCH_SIZE)) == (want, str(BATCH_BYTES))
    spark.conf.unset(BATCH)
    spark.conf.unset(BATCH_SIZE)
