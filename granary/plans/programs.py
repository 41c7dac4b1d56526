"""Queries over programs: definitions in sources that hold whole documents, ignore rules, bound calls, factored batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import bindings, symbols
from granary.plans.registry import query, table
from granary.plans.reports import PARTS, fmt, parts, put
from granary.session import spread
from granary.sources import ignore


def _files(docs, path: str, *parts):
    return docs.select(F.format_string(path, "doc_id").alias("path"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


def _expected(path: str, *rows: tuple[str, str, str, str, str]) -> str:
    listed = ", ".join(f"('{kind}', {start}, {end}, {name}, {owner})" for kind, start, end, name, owner in rows)
    return f"SELECT '{path}' || doc_id AS file, kind, s AS start, e AS \"end\", name, owner FROM d, LATERAL (VALUES {listed}) v(kind, s, e, name, owner)"


_DOC, _D = "'Doc' || doc_id", "'d' || doc_id"
_HIDDEN = "WITH d AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS n FROM documents WHERE text IS NOT NULL) " + " UNION ALL ".join(
    [
        _expected("rs/", ("const", "n + 4", "2 * n + 6", "'S'", "NULL"), ("impl", "2 * n + 7", "2 * n + 9", _DOC, "NULL"), ("function", "2 * n + 8", "2 * n + 8", "'go'", _DOC)),
        _expected("ts/", ("class", "1", "n + 5", _DOC, "NULL"), ("method", "n + 4", "n + 4", "'go'", _DOC)),
        _expected("py/", ("class", "1", "2 * n + 8", _DOC, "NULL"), ("method", "n + 5", "2 * n + 8", "'go'", _DOC), ("function", "2 * n + 10", "2 * n + 10", "'top'", "NULL")),
        _expected("cpp/", ("namespace", "2", "n + 8", _D, "NULL"), ("function", "n + 7", "n + 7", "'go'", _D)),
    ]
)


@query(_HIDDEN)
def hidden_definitions(spark, sf):
    """Definitions of sources in four languages that hold each document, and definitions that are none, in nested comments, raw strings, templates and docstrings; quotes, braces and slashes of the texts stay as far as the string's own end allows."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    but = lambda taken: reduce(lambda text, c: F.replace(text, F.lit(c), F.lit("|")), taken, F.col("text"))  # noqa: E731  (translate goes character by character)
    number = F.col("doc_id").cast("string")
    rust = _files(docs, "rs/%d.rs", "/*", but("/#"), "\nfn fake() {\n/* in */ */\nconst S: &str = r##\"", but("/#"), '\nfn fake() {\n"##;\nimpl Doc', number, " {\n    fn go<'a>(&'a self, c: char) -> u8 { if c == '{' { 1 } else { 2 } }\n}\n")
    script = _files(docs, "ts/%d.ts", "class Doc", number, " {\n  text = `", but("`\\$"), "\nfunction fake() { ${ `{nested ${1}` } }`;\n  go(x: number) { return /[{'\"]/.test(`}`); }\n}\n")
    python = _files(docs, "py/%d.py", "class Doc", number, ':\n    """', but('"\\'), "\n    def fake(self):\n    \"\"\"\n    def go(self, a={'x': ':'}):\n        return '''", but("'\\"), "\n    def fake(self):\n    '''\n\ndef top(): pass\n")
    cpp = _files(docs, "cpp/%d.cpp", "#define NO void no() {\nnamespace d", number, ' {\nauto s = R"x(', but(")"), '\nvoid fake() {\n)x";\ntemplate <class T>\nT go(T a) { return a; }\n}\n')
    found = symbols.symbols_of(rust.unionByName(script).unionByName(python).unionByName(cpp))
    return found.select(F.regexp_replace("path", r"\.\w+$", "").alias("file"), "kind", "start", "end", "name", "owner")


@query(
    "SELECT lang || '/' || source || '/' || doc_id % 10 || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.log' WHEN doc_id % 3 = 1 THEN '.txt' ELSE '.md' END AS path FROM documents WHERE NOT coalesce("
    # *.log but not *5.log; 7/ under each language whatever its files are; [12]/?*[0-9].md under each source
    "(doc_id % 3 = 0 AND doc_id % 10 <> 5) OR doc_id % 10 = 7 OR (doc_id % 10 IN (1, 2) AND doc_id % 3 = 2 AND doc_id > 9), false) AND lang IS NOT NULL AND source IS NOT NULL"
)
def walked_files(spark, sf):
    """Files of a tree of languages, sources and last digits that its ignore files leave: a rule of the root, one taken back, folders of each language, a class of names in each source."""
    docs = table(spark, sf, "documents").where("lang is not null and source is not null")
    ending = F.when(F.col("doc_id") % 3 == 0, ".log").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".md")
    tree = docs.select(F.concat_ws("/", "lang", "source", (F.col("doc_id") % 10).cast("string"), F.concat(F.col("doc_id").cast("string"), ending)).alias("path"), F.lit("").alias("text"))
    root = spark.range(1).select(F.lit(".gitignore").alias("path"), F.lit("# logs\n*.log\n!*5.log\nb*/**/x\n").alias("text"))
    langs = docs.select(F.concat("lang", F.lit("/.gitignore")).alias("path"), F.lit("7/\n!7/*.txt\n").alias("text")).distinct()
    sources = docs.select(F.concat_ws("/", "lang", "source", F.lit(".gitignore")).alias("path"), F.lit("/[12]/?*[0-9].md").alias("text")).distinct()
    every = tree.unionByName(root).unionByName(langs).unionByName(sources)
    return ignore.walk(every).where("path not like '%.gitignore'").select("path")


def _two_namesakes(spark, sf):
    """Files a and b that define the same functions, and c that imports each from one of them under another name; the three of a key are written in one pass."""
    each = spread(parts(spark, sf), "f").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("pk"))).alias("all"))
    lines = lambda line: F.array_join(F.transform("all", lambda x: line(x["pk"])), "\n")
    both = lines(lambda pk: put("def part_%d(size):\n    '''calls gone_%d(size)'''\n    return len(size)  # and never(size)\n", pk, pk))
    head = lines(lambda pk: put("from .%s%d import part_%d as p%d", F.when(pk % 2 == 0, "a").otherwise("b"), "f", pk, pk))
    own = put("\n\nclass Main%d:\n    def own(self, x):\n        def inner(y): return y\n        return inner(x)\n\n    def run(self, x):\n", "f")
    body = lines(lambda pk: put("        p%d(x)\n        self.own(part_%d(x))", pk, pk))
    named = lambda name, text: F.struct(put(f"src/{name}%d.py", "f").alias("path"), text.alias("text"))
    return each.select(F.inline(F.array(named("a", both), named("b", both), named("c", F.concat(head, own, body)))))


@query(
    f"""WITH p AS (SELECT *, 'src/c' || f || '.py' AS c FROM {PARTS} p), n AS (SELECT f, c, count(*) AS n FROM p GROUP BY f, c), lines AS (SELECT p.*, n.n + 8 + 2 * i AS line FROM p JOIN n USING (f, c))
SELECT c AS file, 'run' AS caller, 'p' || pk AS callee, 'src/' || CASE WHEN pk % 2 = 0 THEN 'a' ELSE 'b' END || f || '.py' AS callee_file, line AS first_line, 1::BIGINT AS calls, 0::BIGINT AS ambiguous FROM lines
UNION ALL SELECT c, 'run', 'part_' || pk, NULL, line + 1, 1, 2 FROM lines
UNION ALL SELECT c, 'run', 'own', c, min(line) + 1, count(*), 0 FROM lines GROUP BY c
UNION ALL SELECT c, 'own', 'inner', c, n + 5, 1, 0 FROM n
UNION ALL SELECT 'src/' || x || f || '.py', 'part_' || pk, 'len', NULL, 4 * i + 3, 1, 0 FROM p, (VALUES ('a'), ('b')) v(x)"""
)
def bound_calls(spark, sf):
    """Calls bound through imports under other names, classes and scopes, where two files define every name; names in strings and comments are none."""
    out = bindings.bound_calls(_two_namesakes(spark, sf))
    return out.select("file", "caller", "callee", "callee_file", F.col("first_line").cast("bigint").alias("first_line"), "calls", "ambiguous")


def _ring(spark, sf):
    """Files of twenty parts' functions, each of which calls the next one's; spread before the window, or one task parses all."""
    w = Window.partitionBy("f").orderBy("pk")
    p = spread(parts(spark, sf), "f").withColumn("next", F.lead("pk").over(w)).withColumn("first", F.min("pk").over(Window.partitionBy("f")))
    return p.select("f", "pk", "first", fmt("src/p%d.py", "pk").alias("path"), fmt("from .p%d import run as go\n\ndef run(x):\n    return go(x)\n", F.coalesce("next", "first")).alias("text"))


@query(f"SELECT f, i AS hops, count(*) AS nodes FROM {PARTS} p WHERE i <= 5 GROUP BY f, i")
def calls_to_depth(spark, sf):
    """Functions within five calls of each ring's first; each is called run, stands in a file of its own and imports the next one's, the last one the first's."""
    files = _ring(spark, sf)
    start = files.where("pk = first").select(F.concat("path", F.lit("#3-4")).alias("node"))
    got = bindings.reached(bindings.bound_calls(files), start)
    of = files.select("f", F.concat("path", F.lit("#3-4")).alias("node"))
    return got.join(of, "node").groupBy("f", F.col("hops").cast("bigint").alias("hops")).agg(F.count("*").alias("nodes"))
