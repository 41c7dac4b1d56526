"""Packs against the greedy rule, sums by blocks, digests by version."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import digests, history, scored, symbols
from granary.operators import lines as lines_of


@pytest.mark.parametrize("budget", [0, 400, 520, 700, 10_000])
def test_pack_fills_like_the_greedy_rule(spark, budget):
    rng = random.Random(2)
    files = [(f"s/f{i}.py", "\n".join(f"def {rng.choice(['login', 'logout', 'other'])}_{i}_{j}(user):\n" + "    x = 1\n" * rng.randint(1, 30) for j in range(6))) for i in range(11)] + [("s/none.py", None), ("s/empty.py", "")]
    df = spark.createDataFrame(files, "path string, text string")
    every = scored.context_pack(df, ["login", "user"], 1 << 30).orderBy("n").collect()
    got = scored.context_pack(df, ["login", "user"], budget).orderBy("n").collect()
    costs = {r.n: r.c for r in spark.createDataFrame([(r.n, r.body) for r in every], "n long, body string").select("n", T.est_tokens("body").alias("c")).collect()}
    used = every[0].used - sum(costs.values())
    taken, omitted = [], 0
    for n in sorted(costs):
        if used + costs[n] <= budget:
            used += costs[n]
            taken.append(n)
        else:
            omitted += 1
    assert [r.n for r in got if r.body is not None] == taken
    assert {(r.used, r.omitted) for r in got} == {(used, omitted)}
    assert len({r.path for r in every}) <= 8


def test_pack_of_nothing(spark):
    assert scored.context_pack(spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", None)], "path string, text string"), ["absent"], 100).collect() == []


def test_sums_within_long_and_nested_spans(spark):
    rng = random.Random(4)
    values = [("p", n, rng.randint(0, 3)) for n in range(1, 700)] + [("q", 5, 1)]
    spans = [("p", a, a + rng.choice([0, 1, 63, 64, 65, 300]), f"s{a}") for a in (1, 2, 63, 64, 65, 127, 128, 400, 690)] + [("q", 6, 9, "none"), ("r", 1, 2, "no file")]
    got = scored.sums_within(spark.createDataFrame(values, "path string, line_no long, value long"), spark.createDataFrame(spans, "path string, start long, end long, name string")).collect()
    assert {r.name: r.total for r in got} == {name: sum(v for q, n, v in values if q == p and a <= n <= b) for p, a, b, name in spans}


def test_digest_of_a_later_version(spark):
    files = [(f"src/d{i}/{name}", f"def run_{i}(x):\n    return {i}\n" * (i + 1)) for i in range(6) for name in ("main.py", "util.py", "lib.rs")]
    later = {p: t for p, t in files if "d3" not in p} | {"src/d1/main.py": "def changed(x): pass\n", "src/new/app.py": "def added(): pass", "src/null.py": None}
    both = lambda rows: spark.createDataFrame(list(rows), "path string, text string")
    versions = lambda df: df.select("path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("version"))
    first, second = both(files), both(later.items())
    before = digests.refresh(None, versions(first), first)
    after = digests.refresh(before, versions(second), second)
    again = digests.refresh(after, versions(second), second)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert (before.measured, after.measured, again.measured) == (18, 3, 0)
    whole = digests.refresh(None, versions(second), second)
    assert rows(after.sums) == rows(whole.sums) == rows(again.sums)
    assert rows(after.files.select("path", "version", "tokens", "score")) == rows(whole.files.select("path", "version", "tokens", "score"))
    told = symbols.project_digest(second.where("text is not null"), symbols.symbols_of(second.where("text is not null")))
    assert rows(digests.shown(digests.refresh(None, versions(second.where("text is not null")), second))) == rows(told)


def test_file_changes_of_empty_and_odd_diffs(spark):
    text = "diff --git a/x b/x\nnew file mode 100644\n@@ -0,0 +1 @@\n+a\ndiff --git a/y b/y\ndeleted file mode 100644\n@@ -1 +0,0 @@\n-a\ndiff --git a/z b/z2\nsimilarity index 88%\nrename from z\nrename to z2"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "diff int, text string")
    got = history.file_changes(history.parse_diff(lines_of.explode_lines(df, ["diff"]))).collect()
    assert sorted((r.path, r.old_path, r.status, r.similarity, r.n_hunk, r.n_added, r.n_deleted) for r in got) == [("x", None, "added", None, 1, 1, 0), ("y", None, "deleted", None, 1, 0, 1), ("z2", "z", "renamed", 88, 0, 0, 0)]


def test_sums_within_read_each_side_once(spark):
    values = [("p", n, n % 3) for n in range(1, 300)]
    spans = [("p", 1, 200, "a"), ("p", 1, 200, "a"), ("p", 1, 200, None), ("p", 9, 3, "none"), (None, 1, 2, "no path")]
    out = scored.sums_within(spark.createDataFrame(values, "path string, line_no long, value long"), spark.createDataFrame(spans, "path string, start long, end long, name string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Broadcast" not in plan and plan.count("Scan ") == 2
    total = sum(v for _, n, v in values if n <= 200)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("p", 1, 200, "a", total), ("p", 1, 200, "a", total), ("p", 1, 200, None, total), ("p", 9, 3, "none", 0), (None, 1, 2, "no path", 0)], key=repr)


def test_lines_that_may_branch(spark):
    rng = random.Random(5)
    texts = [*T.BRANCHES, "", "a", "iffy", "forfor(", "x", *["".join(rng.choice([*T.BRANCHES, "a", " ", "if", "#", "é", "漢"]) for _ in range(5)) for _ in range(300)]]
    line = F.col("line")
    rows = spark.createDataFrame([(x,) for x in texts], "line string").select("line", T.complexity_of_line(line).alias("n"), T.may_branch(line).alias("may")).collect()
    count = lambda x: 0 if x.startswith(("//", "#", "*", "/*")) else sum(x.count(b) for b in T.BRANCHES)
    assert [r.n for r in rows] == [count(r.line.strip(" ")) for r in rows]
    assert all(r.may or not r.n for r in rows) and not all(r.may for r in rows)
    plan = scored.complexity_by_symbol(spark.createDataFrame([("a.py", "def f(x):\n    if x: return 1\n")], "path string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("RLIKE") == 1


def test_first_digest_shuffles_no_texts(spark):
    files = spark.range(2000).select(F.format_string("a/%d.py", "id").alias("path"), F.lit("1").alias("version"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = digests._measured(files.select("path", "version"), files.select("path", "text"), 2000, True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "octet_length" in plan.split("SortMergeJoin")[2]  # below the join with the paths
        assert out.agg(F.count("*"), F.sum("tokens"), F.sum("n_lines")).first()[:] == (2000, 2000, 2000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_name_score_works_its_stem_out_once(spark):
    assert str(T.name_score(F.col("stem"))).count("stem") == 1
    assert [r.n for r in spark.createDataFrame([("main",), ("settings",), ("other",), ("",), (None,)], "stem string").select(T.name_score(F.col("stem")).alias("n")).collect()] == [10, 4, 0, 0, 0]
