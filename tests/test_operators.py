"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from granary.operators import analyses, delta, history, lines, relations, rewrite, stats, store, symbols
from granary.sources import files, web


def lines_of(spark, texts, key="file"):
    return lines.explode_lines(spark.createDataFrame([(k, t) for k, t in texts.items()], f"{key} string, text string"), [key])


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_context_and_sketch(spark):
    df = spark.createDataFrame([("a", "one\ntwo\nthree\nfour"), ("b", None), ("c", "")], "file string, text string")
    got = lines.matches_in_context(df, ["file"], "two", 1).first()
    assert (got.line_no, got.context) == (2, ["1: one", "3: three"])
    body = lines_of(spark, {"a": "fn f() {\nplain\nplain\n// note\nif x {\n}\nplain"})
    assert [r.line for r in lines.sketch(body, ["file"]).orderBy("line_no").collect()] == ["fn f() {", "… 3 line(s) …", "if x {", "}", "… 1 line(s) …"]


def test_islands_tail_and_levels(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "u string, i long, v string")
    got = rows(lines.islands(df, ["u"], ["i"], "v").select("v", "first", "last", "rows"), "first")
    assert got == [("a", 0, 1, 2), (None, 2, 3, 2), ("b", 4, 4, 1), ("a", 5, 5, 1)]
    assert [r.i for r in lines.adjacent_distinct(df, ["u"], ["i"], "v").orderBy("i").collect()] == [0, 2, 4, 5]
    log = lines_of(spark, {"l": "\n".join(["ERROR a"] * 5 + ["info b"] * 29 + ["FATAL c"])})
    assert [r.line for r in lines.log_tail(log, ["file"], 3, "error").collect()] == ["FATAL c"]
    assert rows(lines.level_counts(log, ["file"]), "file") == [("l", 6, 0, 29, 0, 0)]


def test_stats(spark):
    df = spark.createDataFrame([("a.py", "py", "x = 1\ny"), ("b.rs", "rs", "fn f() {}\n" * 4)], "path string, lang string, text string")
    got = {r.lang: r for r in stats.workspace_stats(stats.measured(df)).collect()}
    assert got["rs"].lines == 4 and got["py"].files == 1 and abs(sum(r.pct for r in got.values()) - 100) < 0.2
    tree = stats.directory_tree(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e",)], "path string"), depth=2)
    assert rows(stats.rendered_tree(tree), "entry") == [("a", "a/"), ("a/b", "  b/"), ("a/d.py", "  d.py"), ("e", "e")]
    mix = stats.language_mix(spark.createDataFrame([("a.rs",), ("x/Cargo.toml",)], "path string"))
    assert {r.language: r.score for r in mix.collect()} == {"rust": 11, "toml": 1}


def test_ownership_and_logs(spark):
    text = "\x1eann\x1f2024-02-01\n3\t1\ta.py\n-\t-\tb.bin\n\x1ebob\x1f2024-01-01\n1\t0\ta.py"
    log = lines_of(spark, {"g": text}).withColumnRenamed("file", "log")
    stat = history.parse_numstat(log)
    assert rows(stat.select("path", "author", "added", "deleted"), "path", "author") == [("a.py", "ann", 3, 1), ("a.py", "bob", 1, 0), ("b.bin", "ann", 0, 0)]
    got = rows(history.code_ownership(stat).where("path = 'a.py'").select("churn", "last_modified", "rank", "author", "share"), "rank")
    assert got == [(2, "2024-02-01", 1, "ann", 75.0), (2, "2024-02-01", 2, "bob", 25.0)]


def test_structural_diff_blame_and_stash(spark):
    text = "diff --git a/x.rs b/x.rs\nindex 1..2\n--- a/x.rs\n+++ b/x.rs\n@@ -1,2 +1,3 @@ fn main()\n+new\n-old\n same\n@@ -9 +9 @@\n+top\ndiff --git a/y b/y\nnew file mode 1\n--- /dev/null\n+++ b/y\n@@ -0,0 +1 @@\n+z"
    parsed = history.parse_diff(lines_of(spark, {"d": text}, "diff"))
    got = rows(history.structural_diff(parsed).drop("diff"), "path", "symbol")
    assert got == [("x.rs", "modified", "(top-level)", 1, 1, 0), ("x.rs", "modified", "fn main()", 1, 1, 1), ("y", "added", "(top-level)", 1, 1, 0)]
    sha = "a" * 40
    blame = lines_of(spark, {"b": f"{sha} 1 1 2\nauthor Ann\nauthor-time 86400\n\tfirst\n{sha} 2 2\n\tsecond"}, "blame")
    assert rows(history.parse_blame(blame).drop("blame"), "at") == [(1, "aaaaaaa", "Ann", "1970-01-02", "first"), (2, "aaaaaaa", "Ann", "1970-01-02", "second")]
    stash = spark.createDataFrame([("stash@{0}\x1f2024\x1fWIP on main: x",), ("stash@{1}\x1f2024\x1fother",)], "line string")
    assert rows(history.parse_stash(stash).select("index", "branch"), "index") == [(0, "main"), (1, "unknown")]


def test_coverage_counts_nested_symbols_and_both_ends(spark):
    hit = spark.createDataFrame([("f", 1, True), ("f", 3, False), ("f", 5, True)], "file string, line_no long, hit boolean")
    symbols = spark.createDataFrame([("f", "outer", 1, 5), ("f", "inner", 3, 4), ("g", "none", 1, 9)], "file string, name string, start long, `end` long")
    assert rows(relations.coverage(hit, symbols).select("name", "covered", "total", "pct"), "name") == [("inner", 0, 1, 0.0), ("none", 0, 0, 100.0), ("outer", 2, 3, 66.7)]


def test_dead_code_and_calls(spark):
    text = {"a.py": "def used():\n    pass\ndef dead():\n    dead()\nused()"}
    symbols = spark.createDataFrame([("a.py", "function", "used", "def used()", 1, 2), ("a.py", "function", "dead", "def dead()", 3, 4), ("a.py", "function", "main", "def main()", 9, 9)], "file string, kind string, name string, signature string, start long, `end` long")
    assert [r.name for r in relations.dead_code(symbols, relations.mentions(lines_of(spark, text))).collect()] == ["dead"]
    calls = spark.createDataFrame([("f", 2, "b"), ("f", 3, "b"), ("f", 6, "a"), ("f", 0, "x")], "file string, line_no long, callee string")
    defs = spark.createDataFrame([("f", 1, "a"), ("f", 5, "b")], "file string, line_no long, name string")
    edges = relations.call_edges(calls, defs)
    assert rows(edges.select("caller", "callee", "calls"), "caller") == [("a", "b", 2), ("b", "a", 1)]
    got = relations.reachable(edges.select("caller", "callee"), spark.createDataFrame([("a",)], "node string"), 3)
    assert rows(got, "node") == [("a", 0), ("b", 1)]


def test_schema_and_line_diffs(spark):
    b = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, v long")
    a = spark.createDataFrame([("x", 2), ("y", None), ("w", 4)], "k string, v long")
    assert rows(relations.schema_diff(b, a, ["k"], ["v"]).select("k", "change"), "k") == [("w", "added"), ("x", "modified"), ("z", "removed")]
    one, two = lines_of(spark, {"f": "a\nb\nb"}).drop("line_no"), lines_of(spark, {"f": "b\nc"}).drop("line_no")
    assert rows(relations.line_set_diff(one, two, ["file"]).select("change", "line"), "line") == [("removed", "a"), ("added", "c")]


def test_ledgers(spark):
    turns = spark.createDataFrame([("k", 1, "a\nb\nc"), ("k", 2, "a\nb\nc"), ("k", 3, "a\nb\nX"), ("j", 1, "z")], "k string, n long, text string")
    assert rows(delta.read_ledger(turns, ["k"], ["n"], "text"), "k", "n") == [("j", 1, "full"), ("k", 1, "full"), ("k", 2, "unchanged"), ("k", 3, "changed")]
    long = "\n".join(f"line {i} of a longer text" for i in range(40))
    assert delta.ledger_answer(None, "x") == ("full", "x") and delta.ledger_answer("x", "x") == ("unchanged", "")
    assert delta.ledger_answer(long, long + "\nmore")[0] == "diff" and delta.ledger_answer("a", "b")[0] == "full"
    runs = spark.createDataFrame([("k", 1, ["e1", "e2"]), ("k", 2, ["e2", "e3"])], "k string, n long, messages array<string>")
    assert rows(delta.run_delta(runs, ["k"], "n"), "n") == [("k", 1, ["e1", "e2"], [], []), ("k", 2, ["e3"], ["e1"], ["e2"])]


def test_factor(spark):
    body = [f"line {i} of a rather long body of text" for i in range(33)]
    one, two, three = "\n".join(body), "\n".join([*body[:20], "another", *body[21:]]), "\n".join([*body[:10], "x", "y"])
    df = spark.createDataFrame([("b", 1, one), ("b", 2, two), ("b", 3, "q"), ("b", 4, three), ("b", 5, None)], "b string, id long, text string")
    got = {r.id: (r.template_ref, r.ratio and round(r.ratio, 3)) for r in delta.factor(df, ["b"], "id", "text").collect()}
    assert got == {1: (None, None), 2: (1, 0.97), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert "+another" in delta.factor(df, ["b"], "id", "text").where("id = 2").first().diff
    assert delta.line_ratio([], []) == 1.0 and delta.line_ratio(["a"], []) == 0.0
    assert delta.factorable_text('[{"content": "a"}, {"value": "b"}]') == "a\nb" and delta.factorable_text('[{"n": 1}]') is None and delta.factorable_text("{") is None


def test_line_ratio_equals_the_plain_table():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 70))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert delta.line_ratio(a, b) == (2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0)


def test_ledgers(spark):
    df = spark.createDataFrame([(1, "t"), (2, None), (3, None), (4, "t")], "id long, text string")
    assert rows(delta.content_dedup(df, "id", "text"), "id") == [(1, 1, "fresh"), (2, 2, "fresh"), (3, 2, "already_sent"), (4, 1, "already_sent")]
    sent = spark.createDataFrame([("p", 1, "a", 1, "r1"), ("p", 2, "a", 1, "r1"), ("p", 3, "a", 2, "r1"), ("p", 4, "a", 2, "r2"), ("p", 5, "b", 2, "r2"), ("p", 6, "b", 2, "r2"), ("q", 1, None, 1, "r1"), ("q", 2, None, 1, "r2")], "p string, n long, t string, m long, run string")
    got = rows(delta.content_ledger(sent, ["p"], "n", "t", "m", "run"), "p", "n")
    assert [r[2] for r in got] == ["fresh", "already_sent", "fresh", "cold", "fresh", "already_sent", "fresh", "cold"]
    assert delta.delta_reset(sent, "p", "q").count() == 6 and delta.delta_reset(sent, "p").count() == 0
    runs = spark.createDataFrame([("c", 1, False, "s1", ["E1", "E2"], []), ("c", 2, False, "s2", ["E2", "E3"], ["w"]), ("c", 3, True, "s3", [], []), ("c", 4, True, "s3", [], []), ("d", 1, True, "x", [], [])], "c string, n long, success boolean, summary string, errors array<string>, warnings array<string>")
    got = rows(delta.cmd_report(runs, ["c"], "n").select("n", "success_changed", "summary", "new_errors", "resolved_errors", "unchanged_errors", "new_warnings"), "n")
    assert got == [(2, False, None, ["E3"], 1, 1, ["w"]), (3, True, "s3", [], 2, 0, []), (4, False, None, [], 0, 0, [])]


def test_symbols(spark):
    py = "class A:\n    def f(self):\n        return g(1)\n\ndef g(x):\n    return x\n"
    df = spark.createDataFrame([("m.py", py), ("tests/test_m.py", "def test_g():\n    assert g(2) == h(2)\n"), ("notes.txt", "g")], "path string, text string")
    syms = symbols.symbols_of(df)
    assert rows(syms.select("path", "id", "name"), "path", "start") == [("m.py", "class:1-3", "A"), ("m.py", "method:2-3", "f"), ("m.py", "function:5-6", "g"), ("tests/test_m.py", "function:1-2", "test_g")]
    asked = spark.createDataFrame([("m.py", "function:5-6"), ("m.py", "function:5-60"), ("m.py", "nonsense")], "path string, id string")
    assert {r.id: r.body for r in symbols.bodies(df, asked).collect()} == {"function:5-6": "def g(x):\n    return x", "function:5-60": "Error: out of range function:5-60", "nonsense": "Error: invalid id nonsense"}
    assert symbols.zoomed(df, syms, "skeleton").count() == symbols.zoomed(df, syms, "sketch").count() == symbols.zoomed(df, syms, "body").count() == 4
    patch = spark.createDataFrame([("m.py", "function:5-6", "g", "def g(y):\n    return y"), ("tests/test_m.py", "function:1-2", "other", "x")], "path string, id string, expected_name string, new_body string")
    got = {r.path: r for r in symbols.patch_symbol(df, patch).collect()}
    assert got["m.py"].state == "patched" and got["m.py"].text.endswith("\n\ndef g(y):\n    return y\n") and got["tests/test_m.py"].state == "stale"
    cut = symbols.delete_symbol(df, spark.createDataFrame([("m.py", "method:2-3")], "path string, id string")).first()
    assert cut.text == "class A:\ndef g(x):\n    return x\n" and cut.removed.startswith("    def f")
    put = symbols.insert_symbol(df, spark.createDataFrame([("m.py", "before", "function:5-6", "# note")], "path string, mode string, id string, body string")).first()
    assert put.text.split("\n")[4] == "# note"
    move = spark.createDataFrame([("m.py", "function:5-6", "g", "notes.txt")], "source string, id string, name string, target string")
    got = {r.path: r for r in symbols.move_symbol(df, move).collect()}
    assert got["notes.txt"].text == "g\n\ndef g(x):\n    return x\n" and got["m.py"].referencing == ["tests/test_m.py"] and "def g" not in got["m.py"].text
    lines_ = lines_of(spark, {r.path: r.text for r in df.collect()})
    functions = syms.where("kind in ('function', 'method')").select(F.col("path").alias("file"), "name", "start", "end")
    graph = rows(relations.call_graph(functions, relations.calls(lines_)).select("caller", "callee", "callee_file", "first_line"), "caller", "callee")
    assert graph == [("f", "g", "m.py", 3), ("test_g", "g", "m.py", 2), ("test_g", "h", None, 2)]
    hit = relations.refactor_impact(functions, lines_, ["g", "none"]).orderBy("name").collect()
    assert tuple(hit[0]) == ("g", "m.py", 5, 3, 2, 3, 1, 3) and tuple(hit[1]) == ("none", None, None, 0, 0, 0, 0, 0)
    digest = symbols.project_digest(spark.createDataFrame([("src/main.py", py), ("b/c/util.rs", "fn x() {}")], "path string, text string"), symbols.symbols_of(spark.createDataFrame([("src/main.py", py)], "path string, text string")))
    assert [r.line for r in digest.where("part = 'entry points'").collect()] == ["src/main.py | class A | def f(self) | def g(x)"]
    one = spark.createDataFrame([("3-9",), ("9-3",), ("x",)], "r string").select(symbols.parse_range(F.col("r")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in one] == [(3, 9), None, None]


def test_reports(spark):
    found = spark.createDataFrame([("a", 2, 1, "warning", None, "w"), ("a", 2, 1, "warning", None, "w"), ("b", 1, 1, "error", "E1", "e"), ("c", 1, 1, "hint", None, "h")], "file string, line int, col int, severity string, code string, message string")
    assert [r.file for r in analyses.diagnostics_rank(found, 2).collect()] == ["b", "a"]
    assert tuple(analyses.diagnostics_summary(found, 2).first()) == (1, 1, 1, 3, 2) and analyses.diagnostics_summary(found, 9, "warning").first().total == 2
    tests = spark.createDataFrame([("r", "s", "a", "passed"), ("r", "s", "b", "failed"), ("r", "t", "c", "skipped")], "run string, suite string, name string, outcome string")
    assert rows(analyses.suite_summary(tests, ["run"]), "suite") == [("r", "s", 1, 1, 0, ["b"]), ("r", "t", 0, 0, 1, [])]
    frames = spark.createDataFrame([("t", 0, "a.py", 2), ("t", 1, "none.py", 1)], "trace string, n long, file string, line long")
    src = lines_of(spark, {"a.py": "one\ntwo\nthree"})
    assert {r.file: r.source for r in analyses.frames_with_source(frames, src, ["trace"], 1).collect()} == {"a.py": "  1: one\n> 2: two\n  3: three", "none.py": None}
    batch = analyses.batch_read({"good": spark.createDataFrame([("x",)], "content string"), "bad": ValueError("no such file")})
    assert rows(batch, "item") == [("bad", 0, None, "ValueError: no such file"), ("good", 0, "x", None)]
    log = lines_of(spark, {"l": "COMMIT:abcdef0123|a@b.c|2024-01-01|one | two\n\nx.py\ny.py\nCOMMIT:1234567890|d@e.f|2023-01-01|three"}).withColumnRenamed("file", "log")
    assert rows(history.parse_log(log).drop("log", "n"), "sha7") == [("1234567", "d@e.f", "2023-01-01", "three", []), ("abcdef0", "a@b.c", "2024-01-01", "one | two", ["x.py", "y.py"])]
    paths = spark.createDataFrame([(p,) for p in ("src/main.rs", "README.md", "a/b/c/main.py", "x/lib.txt", "tests/test_main.rs", "src/main_test.go", "spec/x_main_y.rb", "contest.py")], "path string")
    assert [r.path for r in files.resources(paths).collect()] == ["README.md", "src/main.rs"]
    got = files.related_tests(paths.where("path = 'src/main.rs'"), paths)
    assert sorted(r.test for r in got.collect()) == ["spec/x_main_y.rb", "src/main_test.go", "tests/test_main.rs"]
    assert sorted(r.path for r in paths.where(files.is_test_file(F.col("path"))).collect()) == ["src/main_test.go", "tests/test_main.rs"]
    stems = spark.createDataFrame([("util",)], "stem string")
    src = lines_of(spark, {"a.py": "from pkg.util import x\nutil = 1", "b.py": "x = util"})
    assert [tuple(r) for r in relations.imported_by(src, stems).collect()] == [("util", "a.py")]


def test_config_values():
    import json

    assert rewrite.set_value("a: 1\nb:\n  c: [1, 2]\n", "b.c[1]", 5, "yaml") == ("a: 1\nb:\n  c:\n  - 1\n  - 5\n", 2)
    toml = '# top\nx = 1\n\n[a.b]\nc = "old" # note\n[z]\n'
    assert rewrite.set_value(toml, "a.b.c", "new", "toml") == ('# top\nx = 1\n\n[a.b]\nc = "new"\n[z]\n', "old")
    assert rewrite.set_value(toml, "a.b.d", True, "toml")[0].split("\n")[5] == "d = true"
    assert rewrite.set_value(toml, "n.m", [1], "toml") == (toml + "\n[n]\nm = [1]", None)
    assert rewrite.set_value(toml, "y", 2, "toml")[0].split("\n")[2] == "y = 2"
    assert json.loads(rewrite.set_value('{"a": 1}', "b.c", 2)[0]) == {"a": 1, "b": {"c": 2}}
    with pytest.raises(ValueError):
        rewrite.write_section("# A\nx", "a", "delete", expected_title="B")


def test_cvss_and_pdf():
    import zlib

    from granary.sources import extract

    assert [extract.cvss_score("CVSS:3.1/" + v) for v in ("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", "AV:L/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N")] == [9.8, 6.1, 0.0]
    data = zlib.compress(b"BT 1 0 0 1 72 720 Tm (TITLE ONE) Tj ET BT 0 0 Td (body \\(a\\)) Tj T* [(sp) 5 (lit)] TJ ET")
    pdf = b"%PDF-1.5\n1 0 obj\n<< /Filter /FlateDecode /Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream\nendobj"
    assert web.pdf_markdown(pdf) == "## TITLE ONE\n\nbody (a)\n\nsplit" and web.pdf_markdown(b"no") is None


def test_pages_without_the_end_of_the_head():
    assert web.markdown_of("<html><head><title>No</title><body><h1>T</h1><p>x") == "# T\n\nx"
    assert web.markdown_of("<head><meta charset=a><style>p{}</style><p>x</p>") == "x"


def test_coverage_over_blocks(spark):
    hits = spark.createDataFrame([("f", n, n % 3 == 0) for n in range(1, 1001)], "file string, line_no long, hit boolean")
    spans = [("a", 1, 1000), ("b", 64, 64), ("c", 63, 129), ("d", 2000, 3000), ("e", 200, 500)]
    got = relations.coverage(hits, spark.createDataFrame([("f", *s) for s in spans], "file string, name string, start long, end long")).collect()
    assert {r.name: (r.covered, r.total) for r in got} == {n: (sum(i % 3 == 0 for i in range(a, min(b, 1000) + 1)), max(0, min(b, 1000) - a + 1)) for n, a, b in spans}
    assert tuple(relations.overall_coverage(hits).first()) == (333, 1000, 33.3)


def test_store(spark):
    schema = "key string, value string, tags array<string>, created_at long, updated_at long"
    old = spark.createDataFrame([("a", "1", ["t"], 1, 1), ("b", "2", [], 2, 2)], schema)
    new = store.upsert(old, spark.createDataFrame([("a", "Hello", ["t"], 9, 9)], schema), "key")
    assert rows(new.select("key", "value", "created_at", "updated_at"), "key") == [("a", "Hello", 1, 9), ("b", "2", 2, 2)]
    assert [r.key for r in store.memory_list(new, tag="t", search="HELL").collect()] == ["a"]
    assert store.deleted(new, "key", "a").count() == 1 and store.memory_get(new, "b").count() == 1
    tasks = store.task_create(spark.createDataFrame([], "id long, title string, status string, priority int, tags array<string>, created_at long"), id=1, title="t", created_at=5)
    assert rows(store.task_update(tasks, 1, status="done", title=None).select("title", "status", "priority"), "title") == [("t", "done", 0)]
    sessions = spark.createDataFrame([(1, '{"a": 1}', 5), (2, "{broken", 6)], "id long, snapshot string, created_at long")
    assert [r.id for r in store.session_list(sessions, 1).collect()] == [2]
    assert store.session_restore(sessions, 2).where("snapshot is null").count() == 1
    assert store.session_restore(sessions, 1).select(F.variant_get("snapshot", "$.a", "int")).first()[0] == 1


def test_security(spark):
    text = 'x = eval(y)\n// eval(z)\nprint("eval( is named")\nmyeval(x)\npassword = "hunter2"\neval(a) # ignore-security\n#[cfg(test)]\neval(b)'
    got = rows(analyses.security_surface(spark.createDataFrame([("f", text)], "file string, text string"), ["file"]).select("line_no", "category", "confidence"), "line_no")
    assert got == [(1, "xss", "medium"), (5, "secrets", "high")]
    found = analyses.security_surface(spark.createDataFrame([("f", text)], "file string, text string"), ["file"])
    assert [r.line_no for r in analyses.ranked_findings(found, ["file"]).collect()] == [5, 1]
    assert ("category", "xss", 1) in rows(analyses.rollup(found), "by", "value")
    assert len({r[3] for r in analyses.rules()}) == len(analyses.rules())


def test_budget_fill_skips_and_goes_on(spark):
    df = spark.createDataFrame([("q", 1, 60), ("q", 2, 50), ("q", 3, 40)], "q string, id long, cost long")
    got = analyses.budget_fill(df, ["q"], ["id"], "cost", 100).first()
    assert ([x.id for x in got.taken], got.used, got.omitted) == ([1, 3], 100, 1)


def test_top_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    assert [r.id for r in analyses.top_cosine(df, "id", "v", [1.0, 0.1], 2).collect()] == [1, 3]


def test_rewrites(spark):
    df = lines_of(spark, {"f": "foo food foo\nbar"})
    assert rows(rewrite.rename(df, ["file"], "foo", "baz").drop("file"), "line_no") == [(1, "foo food foo", "baz food baz", 2)]
    with pytest.raises(ValueError):
        rewrite.rename(df, ["file"], "foo", "1x")
    t = spark.createDataFrame([("a b a", 1), ("a b", 2)], "text string, i int")
    got = rewrite.apply_edits(t, "text", [("b", "c"), ("a", "d")]).orderBy("i").collect()
    assert [(r.ok, r.edited) for r in got] == [(False, "a b a"), (True, "d c")]
    cut = rewrite.delete_lines(lines_of(spark, {"f": "a\nb\n\nc"}), ["file"], 2, 2)
    assert rewrite.joined_lines(cut, ["file"], "line_no").first().text == "a\nc"
    put = rewrite.insert_lines(lines_of(spark, {"f": "a\nb"}), ["file"], 1, ["x", "y"])
    assert rewrite.joined_lines(put, ["file"], "at").first().text == "a\nx\ny\nb"
    assert rewrite.edit_imports("import a\nimport b\n\nx", ["import c", "import a"], ["import b"]) == ("import a\nimport c\n\nx", 1, 1, 1)
    assert rewrite.set_value('{"a": [1, 2]}', "a[1]", 5)[1] == 2
    assert rewrite.set_value("{}", "x.y", True) == ('{\n  "x": {\n    "y": true\n  }\n}', None)
    md = "# A\n\ntext\n\n## B\n\nmore\n\n# C\nend"
    assert rewrite.write_section(md, "b", "delete") == "# A\n\ntext\n\n# C\nend"
    assert rewrite.write_section(md, "c", "append", "last") == "# A\n\ntext\n\n## B\n\nmore\n\n# C\nend\n\nlast"


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe broken")
    got = files.read_tree(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.content, r.size_bytes) for r in got] == [("a.py", "x = 1\n", 6)]
    paths = spark.createDataFrame([("/r/a",), ("/r/../x",), ("/q/a",)], "path string")
    assert [r.path for r in paths.where(files.within(F.col("path"), "/r")).collect()] == ["/r/a"]
    some = spark.createDataFrame([("src/foo.py",), ("tests/test_foo.py",), ("src/foo_test.go",), ("src/bar.py",)], "path string")
    assert [r.test for r in files.related_tests(some.where("path = 'src/foo.py'"), some).orderBy("test").collect()] == ["src/foo_test.go", "tests/test_foo.py"]
    found = files.first_present({"lcov.info": None, "coverage.json": None}, spark.createDataFrame([("a/coverage.json",), ("a/lcov.info",), ("b/coverage.json",)], "path string"))
    assert [r.path for r in found.orderBy("path").collect()] == ["a/lcov.info", "b/coverage.json"]


def test_markdown_of_pages():
    page = "<html><head><title>x</title></head><body><h1>T &amp; x</h1><!-- c --><p>a <b>b</b> <a href='/l'>l</a></p><ul><li>1<li>2</ul><pre>x  y</pre><script>no</script></body></html>"
    assert web.markdown_of(page) == "# T & x\n\na **b** [l](/l)\n\n- 1\n- 2\n\n```\nx  y\n```"
    assert web.markdown_of(None) == ""
