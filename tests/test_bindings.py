"""Calls bound by scope and import, in several languages."""

from granary.operators import bindings
from granary.plans import programs
from granary.sources import code

FILES = [
    ("src/util.ts", "export function load(x) { return x; }\nexport class Crate {\n  open() { return load(1); }\n  static make() { return new Crate(); }\n}\n"),
    ("src/other.ts", "export function load(x) { return x; }\nclass Crate { open() {} }\n"),
    ("src/main.ts", 'import { load as read, Crate } from "./util"\nimport * as tools from "./other"\nfunction main() {\n  read(1); // load(2)\n  tools.load(3);\n  Crate.make();\n  load(4);\n  "load(5)";\n  helper();\n  function helper() { if (x) { main(); } }\n}\n'),
    ("p/a.py", "from . import b\nimport q.c\nclass A:\n    def go(self):\n        self.stay()\n        b.go()\n        c.go()\n        c.missing()\n    def stay(self): return None\n"),
    ("p/b.py", "def go(): pass\n"),
    ("q/c.py", "def go(): pass\n\ndef stay(): pass\n"),
]


def test_calls_are_bound(spark):
    df = spark.createDataFrame(FILES, "path string, text string")
    got = {(r.file, r.caller, r.callee, r.callee_file, r.calls, r.ambiguous) for r in bindings.bound_calls(df).collect()}
    want = {
        ("src/util.ts", "open", "load", "src/util.ts", 1, 0), ("src/util.ts", "make", "Crate", "src/util.ts", 1, 0),
        ("src/main.ts", "main", "read", "src/util.ts", 1, 0), ("src/main.ts", "main", "make", "src/util.ts", 1, 0),
        ("src/main.ts", "main", "helper", "src/main.ts", 1, 0), ("src/main.ts", "helper", "main", "src/main.ts", 1, 0),
        ("p/a.py", "go", "stay", "p/a.py", 1, 0), ("p/a.py", "go", "missing", None, 1, 0),
    }
    assert want <= got
    loads = [x for x in got if x[0] == "src/main.ts" and x[2] == "load"]
    assert sorted(loads, key=str) == [("src/main.ts", "main", "load", "src/other.ts", 1, 0), ("src/main.ts", "main", "load", None, 1, 2)]
    goes = {x[3] for x in got if x[:3] == ("p/a.py", "go", "go")}
    assert goes == {"p/b.py", "q/c.py"}


def test_reached_over_a_cycle(spark):
    df = spark.createDataFrame(FILES, "path string, text string")
    bound = bindings.bound_calls(df)
    start = bound.where("caller = 'main'").selectExpr("caller_id as node").distinct()
    got = {r.node: r.hops for r in bindings.reached(bound, start).collect()}
    assert got["src/main.ts#3-11"] == 0 and got["src/main.ts#10-10"] == 1 and got["src/util.ts#1-1"] == 1 and got["src/util.ts#2-5"] == 2
    back = {r.node for r in bindings.reached(bound, spark.createDataFrame([("src/util.ts#1-1",)], "node string"), 1, callers=True).collect()}
    assert back == {"src/util.ts#1-1", "src/main.ts#3-11", "src/util.ts#3-3"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_and_joins_are_by_merge(spark, sf):
    texts = programs._two_namesakes(spark, sf)
    assert "Join" not in plan(texts) and plan(texts).count("Scan parquet") == 1 and "AQEShuffleRead" not in plan(texts)
    assert texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound = bindings.bound_calls(spark.createDataFrame(FILES, "path string, text string"))
    assert "InArrow" not in plan(bound) and "Broadcast" not in plan(bound)


def test_one_reading_gives_what_two_give():
    for path, text in [*FILES, ("x", "f(1)"), ("a.go", "func (t T) A() { b() }\n"), ("b.py", "")]:
        ext = path.rsplit(".", 1)[-1]
        assert code.definitions_and_calls(ext)(text) == (code.definitions(ext)(text), code.calls(ext)(text))


def test_a_name_called_everywhere(spark):
    """Unbound calls of one name in very many files, of a name that few files define, and files without a text or a row."""
    callers = [(f"m{i}.py", f"def run{i}():\n    shared(1)\n    shared(2)\n    gone()\n") for i in range(600)]
    other = [("d1.py", "def shared(x): pass\n"), ("d2.py", "def shared(x): pass\n"), ("e.py", ""), ("n.py", None), (None, "def shared(x): shared(x)\n"), ("k.py", "import e\nimport n\ndef go():\n    e.gone()\n    n.shared()\n")]
    rows = bindings.bound_calls(spark.createDataFrame(callers + other, "path string, text string").repartition(5)).collect()
    got = sorted(((r.file, r.caller, r.callee, r.callee_file, r.callee_id, r.calls, r.ambiguous) for r in rows), key=str)
    want = [x for i in range(600) for x in ((f"m{i}.py", f"run{i}", "shared", None, None, 2, 2), (f"m{i}.py", f"run{i}", "gone", None, None, 1, 0))]
    want += [("k.py", "go", "gone", None, None, 1, 0), ("k.py", "go", "shared", None, None, 1, 2)]
    assert got == sorted(want, key=str)
