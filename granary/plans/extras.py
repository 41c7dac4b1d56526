"""Queries of scalar rules, edits, stores, ledgers and streams, each with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import analyses, delta, factoring, history, lines, relations, rewrite, stats, store, symbols
from granary.plans.corpus import KW, KW_SQL, LINES, PAGE_H, doc_lines, est
from granary.plans.registry import query, table
from granary.plans.reports import ERRORS, ITEMS, PARTS, errors, fmt, items, listed, parsed, parts, wrapped
from granary.sources import extract as X
from granary.sources import files as files_of
from granary.streaming import ledger

# --- scalar rules, on lines written from parts


#: Lines of build output: what they are, as a format of a part's key.
BUILD = [
    ("error[E0308]: part {}", "error"), ("src/a.c:{}: error: x", "error"), ("npm ERR! part {}", "error"), ("main.go:{}: undefined: x", "error"), ("make: *** [part{}] Error 1", "error"),
    ("warning: unused part {}", "warning"), ("npm WARN part {}", "warning"), ("a.c:{}:2: warning: x", "warning"), ("Compiling part v{}", "noise"), ("Downloading part {}", "noise"), ("all is well with {}", "plain"),
]
_KIND = " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(BUILD))


def _build_lines(spark, sf):
    line = F.lit(None).cast("string")
    for i, (shape, _) in enumerate(BUILD):
        line = F.when(F.col("pk") % len(BUILD) == i, fmt(shape.replace("{}", "%d"), "pk")).otherwise(line)
    return parts(spark, sf).select("pk", line.alias("line"))


@query(f"SELECT pk, CASE pk % {len(BUILD)} {_KIND} END AS kind FROM {PARTS} p")
def build_output(spark, sf):
    """Lines of build output: errors, warnings, noise."""
    c = F.col("line")
    return _build_lines(spark, sf).select("pk", F.when(T.is_error_line(c), "error").when(T.is_warning_line(c), "warning").when(T.is_noise_line(c), "noise").otherwise("plain").alias("kind"))


@query(f"SELECT pk, pk % {len(BUILD)} = 3 AS go FROM {PARTS} p")
def go_errors(spark, sf):
    """Which lines of build output are Go errors."""
    return _build_lines(spark, sf).select("pk", T.is_go_error(F.col("line")).alias("go"))


@query(f"SELECT pk, CASE WHEN pk % 2 = 0 THEN 'fn part_' || pk || '()' ELSE '(top-level)' END AS context FROM {PARTS} p")
def hunk_context(spark, sf):
    """The symbol in a hunk's header."""
    return parts(spark, sf).select("pk", T.hunk_context(F.concat(fmt("@@ -%d,2 +%d,3 @@", "pk", "pk"), F.when(F.col("pk") % 2 == 0, fmt(" fn part_%d()", "pk")).otherwise(""))).alias("context"))


STEMS = list(T.NAME_SCORES) + ["other"]
_STEM = f"{STEMS!r}[pk % {len(STEMS)} + 1]"


@query(f"SELECT pk, {[*T.NAME_SCORES.values(), 0]!r}[pk % {len(STEMS)} + 1]::BIGINT AS score FROM {PARTS} p")
def name_scores(spark, sf):
    """How much file names tell of an entry point."""
    return parts(spark, sf).select("pk", T.name_score(F.element_at(F.array(*[F.lit(x) for x in STEMS]), (F.col("pk") % len(STEMS) + 1).cast("int"))).cast("bigint").alias("score"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '… (truncated)' ELSE text END AS trimmed FROM documents")
def trim_to_budget(spark, sf):
    """Texts cut to a hundred tokens."""
    return table(spark, sf, "documents").select("doc_id", T.trim_to_budget("text", 100).alias("trimmed"))


SIGNATURES = [("pub fn a()", True), ("export class A", True), ("  public int a()", True), ("fn a()", False), ("def public_(x)", False), ("Public Sub A", True)]


@query(f"SELECT pk, {[x for _, x in SIGNATURES]!r}[pk % {len(SIGNATURES)} + 1] AS exported FROM {PARTS} p".replace("True", "true").replace("False", "false"))
def exported_symbols(spark, sf):
    """Which signatures are exported."""
    return parts(spark, sf).select("pk", T.is_exported(F.element_at(F.array(*[F.lit(x) for x, _ in SIGNATURES]), (F.col("pk") % len(SIGNATURES) + 1).cast("int"))).alias("exported"))


@query(f"SELECT pk, strftime(make_timestamp((pk * 100000 * 1000000)::BIGINT), '%Y-%m-%d') AS date FROM {PARTS} p")
def unix_dates(spark, sf):
    """Seconds as dates."""
    return parts(spark, sf).select("pk", T.unix_date(F.col("pk") * 100000).alias("date"))


PATHS = ["src/a.rs", "tests/b.py", "x/test_c.py", "lib/d_test.go", "ui/e.spec.ts", "img/f.png", "app/G.kt", "README.md", "tests", "h.swift", "pkg/fixtures/i.json", "src/latest/j.cpp", "k.lua", "CMakeLists", "spec/l_spec.rb", "m.tfvars"]
_PATH = f"{PATHS!r}[pk % {len(PATHS)} + 1]"


def _paths(spark, sf):
    return parts(spark, sf).select("pk", F.element_at(F.array(*[F.lit(x) for x in PATHS]), (F.col("pk") % len(PATHS) + 1).cast("int")).alias("path"))


_EXT = f"lower(regexp_extract({_PATH}, '\\.([^./]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{lang}'" for e, lang in T.LANGUAGES.items()) + " ELSE ext END"


@query(f"SELECT pk, {_LANG} AS language, ext IN ({', '.join(repr(x) for x in T.BINARY)}) AS binary FROM (SELECT pk, {_EXT} AS ext FROM {PARTS} p) x")
def path_languages(spark, sf):
    """The language of each path, and whether its files hold no text."""
    return _paths(spark, sf).select("pk", T.language(F.col("path")).alias("language"), T.is_binary_path(F.col("path")).alias("binary"))


@query(f"SELECT pk, {', '.join(f'ext IN {v!r} AS {k}' for k, v in T.CODE_EXTENSIONS.items())} FROM (SELECT pk, {_EXT} AS ext FROM {PARTS} p) x")
def code_paths(spark, sf):
    """Which operators take a path for code: seven lists."""
    return _paths(spark, sf).select("pk", *[T.is_code(F.col("path"), k).alias(k) for k in T.CODE_EXTENSIONS])


_DIRS = ", ".join(repr(x) for x in files_of.TEST_DIRS)


@query(f"SELECT pk, list_has_any(string_split(path, '/'), [{_DIRS}]) OR regexp_matches(path, '(_test\\.(go|py|rs)|\\.(test|spec)\\.[jt]sx?|(^|/)test_[^/]*\\.py|Tests?\\.(java|kt|cs))$') AS security, suffix(lower(path), '_spec.rb') OR {' OR '.join(f'contains(lower(path), {x!r})' for x in files_of.TEST_PARTS)} AS impact FROM (SELECT pk, {_PATH} AS path FROM {PARTS} p) x")
def test_paths(spark, sf):
    """Which paths are tests, by two rules."""
    return _paths(spark, sf).select("pk", files_of.is_test_path(F.col("path")).alias("security"), files_of.is_test_file(F.col("path")).alias("impact"))


@query(f"SELECT pk, path LIKE 'src/%' AND regexp_matches(path, '^src/[^/]*$') AS matched FROM (SELECT pk, {_PATH} AS path FROM {PARTS} p) x")
def glob_paths(spark, sf):
    """Paths that fit a glob, whose star stays within a segment."""
    return _paths(spark, sf).select("pk", F.col("path").rlike(T.glob_path("src/*")).alias("matched"))


@query("""SELECT p_partkey AS pk, p_partkey % 3 = 0 AS inside FROM part""")
def scoped_paths(spark, sf):
    """Paths under a root that do not climb out of it."""
    path = F.when(F.col("pk") % 3 == 0, fmt("/root/a/%d", "pk")).when(F.col("pk") % 3 == 1, fmt("/root/a/../../%d", "pk")).otherwise(fmt("/rooted/%d", "pk"))
    return parts(spark, sf).select("pk", files_of.within(path, "/root").alias("inside"))


@query(f"SELECT CASE u.l WHEN 0 THEN 'rust' ELSE 'toml' END AS language, CASE u.l WHEN 0 THEN 11 ELSE 1 END * count(DISTINCT f) AS score FROM {PARTS} p, (VALUES (0), (1)) u(l) GROUP BY u.l")
def language_mix(spark, sf):
    """Languages by files, ten more for a manifest."""
    f = parts(spark, sf).select("f").distinct()
    return stats.language_mix(f.select(F.explode(F.array(fmt("d%d/a.rs", "f"), fmt("d%d/Cargo.toml", "f"))).alias("path")))


@query(f"SELECT path, 'file:///' || path AS uri FROM (SELECT 'README.md' AS path, 0 AS o UNION ALL SELECT DISTINCT 'f' || f || '/main.py', 1 FROM {PARTS} p) x ORDER BY o, path LIMIT 30")
def resource_list(spark, sf):
    """Manifests and entry points as resources."""
    f = parts(spark, sf).select("f").distinct()
    every = f.select(F.explode(F.array(fmt("f%d/main.py", "f"), fmt("f%d/a/b/c/main.py", "f"), fmt("f%d/other.py", "f"), F.lit("README.md"))).alias("path")).distinct()
    return files_of.resources(every)


@query(f"SELECT DISTINCT 'f' || f || '/report' AS dir, CASE WHEN f % 3 = 0 THEN 'lcov.info' WHEN f % 3 = 1 THEN 'coverage.json' ELSE 'cobertura.xml' END AS name FROM {PARTS} p")
def coverage_probing(spark, sf):
    """Of several reports in a folder the first known one."""
    f = parts(spark, sf).select("f").distinct()
    names = F.when(F.col("f") % 3 == 0, F.array(F.lit("cobertura.xml"), F.lit("lcov.info"), F.lit("x"))).when(F.col("f") % 3 == 1, F.array(F.lit("coverage.json"), F.lit("cobertura.xml"))).otherwise(F.array(F.lit("y"), F.lit("cobertura.xml")))
    got = files_of.first_present({"lcov.info": None, "coverage.json": None, "cobertura.xml": None}, f.select("f", F.explode(names).alias("name")).select(F.concat(fmt("f%d/report/", "f"), "name").alias("path")))
    return got.select(F.regexp_replace("dir", "/$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))


@query(f"SELECT pk, CASE WHEN pk % 3 = 0 THEN 'function' END AS kind, CASE WHEN pk % 3 = 0 THEN pk END AS start, CASE WHEN pk % 3 = 0 THEN pk + size END AS \"end\", CASE WHEN pk % 3 < 2 THEN pk END AS first FROM {PARTS} p")
def symbol_ids(spark, sf):
    """Ids and ranges taken apart; others give nothing."""
    id = F.when(F.col("pk") % 3 == 0, fmt("function:%d-%d", "pk", F.col("pk") + F.col("size"))).otherwise(fmt("part %d", "pk"))
    span = F.when(F.col("pk") % 3 < 2, fmt("%d-%d", "pk", F.col("pk") + 1)).otherwise(fmt("%d-%d", F.col("pk") + 1, "pk"))
    return parts(spark, sf).select("pk", symbols.parse_id(id).alias("i"), symbols.parse_range(span)["start"].alias("first")).select("pk", "i.kind", "i.start", "i.end", "first")


# --- edits


def _docs(spark, sf):
    """Files of twenty numbered lines each."""
    return listed(parts(spark, sf), ["f"], ["pk"], fmt("line %d", "pk")).select(fmt("f%d", "f").alias("path"), "text", "f")


DOCS = f"(SELECT f, 'f' || f AS path, string_agg('line ' || pk, chr(10) ORDER BY pk) AS text FROM {PARTS} p GROUP BY f)"


@query(f"SELECT path, CASE WHEN f % 2 = 1 THEN replace(replace(text, 'line 3', 'LINE 3'), 'LINE 3', 'x') ELSE text END AS edited, f % 2 = 1 AS ok FROM (SELECT path, f, text, 0 AS k FROM (SELECT 'f' || f AS path, f, 'a' || f || CASE WHEN f % 2 = 1 THEN ' line 3' ELSE ' line 3 line 3' END AS text FROM (SELECT DISTINCT f FROM {PARTS} p) d) e) t")
def apply_edits(spark, sf):
    """Edits in order, each of which must be found exactly once then, or none holds."""
    f = parts(spark, sf).select("f").distinct()
    text = F.concat(fmt("a%d", "f"), F.when(F.col("f") % 2 == 1, " line 3").otherwise(" line 3 line 3"))
    out = rewrite.apply_edits(f.select(fmt("f%d", "f").alias("path"), text.alias("text")), "text", [("line 3", "LINE 3"), ("LINE 3", "x")])
    return out.select("path", "edited", "ok")


@query(f"SELECT path, array_to_string(list_concat(p[1:2], p[5:]), chr(10)) AS text, array_to_string(p[3:4], chr(10)) AS removed FROM (SELECT path, string_split(text, chr(10)) AS p FROM {DOCS} d WHERE len(string_split(text, chr(10))) >= 4) x")
def delete_symbol(spark, sf):
    """Files without the lines of an id."""
    docs = _docs(spark, sf).where(F.size(F.split("text", "\n")) >= 4)
    return symbols.delete_symbol(docs, docs.select("path", F.lit("function:3-4").alias("id")))


@query(f"SELECT path, array_to_string(list_concat(p[1:m], ['new', 'lines'], p[m + 1:]), chr(10)) AS text FROM (SELECT path, string_split(text, chr(10)) AS p, CASE f % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE len(string_split(text, chr(10))) END AS m FROM {DOCS} d WHERE len(string_split(text, chr(10))) >= 2) x")
def insert_symbol(spark, sf):
    """Files with lines put before or after an id's, or at either end."""
    docs = _docs(spark, sf).where(F.size(F.split("text", "\n")) >= 2)
    mode = F.element_at(F.array(*[F.lit(x) for x in ("start", "before", "after", "end")]), (F.col("f") % 4 + 1).cast("int"))
    return symbols.insert_symbol(docs, docs.select("path", mode.alias("mode"), F.lit("function:2-2").alias("id"), F.lit("new\nlines").alias("body")))


@query(f"SELECT path, CASE WHEN f % 3 = 0 THEN array_to_string(list_concat(p[1:1], ['new'], p[3:]), chr(10)) ELSE text END AS text, CASE f % 3 WHEN 0 THEN 'patched' WHEN 1 THEN 'stale' ELSE 'invalid' END AS state FROM (SELECT path, f, text, string_split(text, chr(10)) AS p FROM {DOCS} d WHERE len(string_split(text, chr(10))) >= 2) x")
def patch_symbol(spark, sf):
    """Files with an id's lines replaced, unless the id is stale or none."""
    docs = _docs(spark, sf).where(F.size(F.split("text", "\n")) >= 2)
    id = F.when(F.col("f") % 3 == 2, "function:2-999").otherwise("function:2-2")
    return symbols.patch_symbol(docs.drop("f"), docs.select("path", id.alias("id"), F.when(F.col("f") % 3 == 1, "other").otherwise("line").alias("expected_name"), F.lit("new").alias("new_body")))


@query(f"""WITH d AS (SELECT f, path, string_split(text, chr(10)) AS p FROM {DOCS} d WHERE len(string_split(text, chr(10))) >= 2), e AS (SELECT a.path AS s, b.path AS t, a.p AS sp, b.p AS tp FROM d a JOIN d b ON b.f = a.f + 1 WHERE a.f % 2 = 0)
SELECT s AS path, array_to_string(sp[2:], chr(10)) AS text FROM e UNION ALL SELECT t, array_to_string(tp, chr(10)) || chr(10) || chr(10) || sp[1] || chr(10) FROM e""")
def move_symbol(spark, sf):
    """Files from which a line goes to the end of the next one."""
    docs = _docs(spark, sf).where(F.size(F.split("text", "\n")) >= 2)
    pairs = docs.where("f % 2 = 0").select(F.col("path").alias("source"), fmt("f%d", F.col("f") + 1).alias("target")).join(docs.select(F.col("path").alias("target")), "target")
    return symbols.move_symbol(docs, pairs.select("source", F.lit("function:1-1").alias("id"), F.lit("none").alias("name"), "target")).select("path", "text")


@query(f"SELECT f, 'import a' || chr(10) || 'import c' || f || chr(10) || 'import n' || chr(10) || chr(10) || 'x = 1' AS text, 1::BIGINT AS added, 1::BIGINT AS removed, 1::BIGINT AS skipped FROM (SELECT DISTINCT f FROM {PARTS} p) d")
def manage_imports(spark, sf):
    """Files with import lines added and removed."""
    f = parts(spark, sf).select("f").distinct().withColumn("text", fmt("import a\nimport b\nimport c%d\n\nx = 1", "f"))
    out = X.rows_of(f, ["f"], "text", lambda t: [rewrite.edit_imports(t, ["import n", "import a"], ["import b"])], "text string, added bigint, removed bigint, skipped bigint")
    return out.select("f", "text", "added", "removed", "skipped")


@query(f"SELECT f, f::VARCHAR AS old, f + 1 AS now, 'y' AS made FROM (SELECT DISTINCT f FROM {PARTS} p) d")
def set_config_value(spark, sf):
    """JSON documents with values set at paths, and the old ones."""

    def change(text: str) -> list[tuple]:
        out, old = rewrite.set_value(text, "a.b[0]", json.loads(text)["a"]["b"][0] + 1)
        out, _ = rewrite.set_value(out, "new.x", "y")
        return [(json.dumps(old), out)]

    f = parts(spark, sf).select("f").distinct().withColumn("text", fmt('{"a":{"b":[%d]}}', "f"))
    rows = parsed(f, ["f"], change, "old string, text string")
    return rows.select("f", "old", F.get_json_object("text", "$.a.b[0]").cast("bigint").alias("now"), F.get_json_object("text", "$.new.x").alias("made"))


MODES = {"replace": "# A\nx\n\n## B\nnew\n\n# C\ny", "delete": "# A\nx\n\n# C\ny", "insert_before": "# A\nx\n\n## B\nnew\n\n## B\nold {}\n\n# C\ny", "insert_after": "# A\nx\n\n## B\nold {}\n\n## B\nnew\n\n# C\ny", "append": "# A\nx\n\n## B\nold {}\n\n## B\nnew\n\n# C\ny"}


@query(f"SELECT f, m AS mode, replace(t, '{{}}', f::VARCHAR) AS text FROM (SELECT DISTINCT f FROM {PARTS} p) d, (VALUES {', '.join('(' + repr(m) + ', ' + ' || chr(10) || '.join(repr(x) for x in t.split(chr(10))) + ')' for m, t in MODES.items())}) v(m, t)")
def write_markdown_section(spark, sf):
    """Markdown files with a section replaced, deleted or put beside another, in each of the modes."""
    f = parts(spark, sf).select("f").distinct().withColumn("text", fmt("# A\nx\n\n## B\nold %d\n\n# C\ny", "f"))
    made = parsed(f, ["f"], lambda t: [(m, rewrite.write_section(t, "b", m, "## B\nnew")) for m in MODES], "mode string, text string")
    return made.select("f", "mode", "text")


# --- stores


def _tasks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.array("o_orderpriority").alias("tags"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey = 7 THEN 9 ELSE substr(o_orderpriority, 1, 1)::INTEGER END AS priority, o_orderpriority AS tag FROM orders WHERE o_orderkey <> 3 UNION ALL SELECT -1, 'pending', 0, ''")
def task_changes(spark, sf):
    """A task made with defaults, one changed, one deleted."""
    out = store.task_update(store.deleted(_tasks(spark, sf), "id", 3), 7, status="done", priority=9, tags=None)
    out = store.task_create(out, id=-1)
    return out.select("id", "status", "priority", F.array_join("tags", ",").alias("tag"))


@query("SELECT o_custkey AS key, max(o_orderkey) AS updated_at FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) GROUP BY 1")
def memory_get(spark, sf):
    """One memory by its key."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("updated_at"), F.col("o_orderkey").alias("created_at"))
    first = o.agg(F.min("key")).first()[0]
    return store.memory_get(store.upsert(o, o.limit(0), "key"), first).select("key", "updated_at")


@query("SELECT event_id AS id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE event_id = 5 UNION ALL SELECT max(event_id) + 1, 42 FROM events")
def session_restore(spark, sf):
    """A stored snapshot and one taken now, as values; a broken one is null."""
    s = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("s").alias("name"), F.col("props").alias("snapshot"), F.col("event_id").alias("created_at"))
    more = store.session_snapshot(s, "new", '{"k": 42}', 0)
    new = more.agg(F.max("id")).first()[0]
    both = store.session_restore(more, 5).unionByName(store.session_restore(more, new))
    return both.select("id", F.variant_get("snapshot", "$.k", "bigint").alias("k"))


# --- ledgers


@query("""WITH s AS (SELECT user_id, event_id, event_type, event_id // 500 AS run, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, last_value(CASE WHEN before IS NULL OR before <> event_type THEN run END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS recorded FROM s)
SELECT user_id, event_id, CASE WHEN before IS NULL OR before <> event_type THEN 'fresh' WHEN run = recorded THEN 'already_sent' ELSE 'cold' END AS state FROM r""")
def content_ledger(spark, sf):
    """Contents of keys: fresh, sent already, or known from an earlier run."""
    e = table(spark, sf, "events").withColumn("mtime", F.lit(0)).withColumn("run", F.floor(F.col("event_id") / 500))
    return delta.content_ledger(e, ["user_id"], "event_id", "event_type", "mtime", "run")


@query("""WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS success, event_type AS summary, lag(event_type <> 'error') OVER w AS ok, lag(event_type) OVER w AS s, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, success <> ok AS success_changed, CASE WHEN success <> ok OR success AND summary <> s THEN summary END AS summary, CASE WHEN event_id // 2 = before // 2 THEN '' ELSE 'E' || event_id // 2 END AS new_errors, CASE WHEN event_id // 2 = before // 2 THEN 0 ELSE 1 END::BIGINT AS resolved, CASE WHEN event_id // 2 = before // 2 THEN 1 ELSE 0 END::BIGINT AS unchanged FROM r WHERE before IS NOT NULL""")
def command_report(spark, sf):
    """Runs against the run before: what errors are new, and the summary where it matters."""
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("summary"), F.array(fmt("E%d", F.floor(F.col("event_id") / 2))).alias("errors"), F.array().cast("array<string>").alias("warnings"))
    got = delta.cmd_report(e, ["user_id"], "event_id")
    return got.select("user_id", "event_id", "success_changed", "summary", F.array_join("new_errors", ",").alias("new_errors"), F.col("resolved_errors").alias("resolved"), F.col("unchanged_errors").alias("unchanged"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT LIKE '%urch%'")
def delta_reset(spark, sf):
    """A ledger without the keys that hold a pattern."""
    return delta.delta_reset(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "urch")


@query(f"SELECT b, id, CASE WHEN id > first THEN first END AS template_ref FROM (SELECT b, id, min(id) OVER (PARTITION BY b) AS first FROM {ERRORS} e) x")
def factored_results(spark, sf):
    """Results of a batch that differ in a line refer to the first."""
    e = errors(spark, sf).withColumn("text", F.concat(F.repeat(F.lit("the same long line of a result\n"), 30), fmt("of %d", "id")))
    return factoring.factor(e, ["b"], "id", "text").select("b", "id", "template_ref")


# --- joins, graphs, digests


@query(f"SELECT f, hop AS hops, count(*) AS nodes FROM (SELECT f, i AS hop FROM {PARTS} p WHERE i <= 3) x GROUP BY f, hop")
def reachable(spark, sf):
    """Functions within three calls of each file's first."""
    p = parts(spark, sf)
    edges = p.select(F.col("pk").alias("caller"), (F.col("pk") + 1).alias("callee")).where(F.floor(F.col("caller") / 20) == F.floor(F.col("callee") / 20)).join(p.select(F.col("pk").alias("callee")), "callee").select("caller", "callee")
    start = p.groupBy("f").agg(F.min("pk").alias("node")).select("node")
    got = relations.reachable(edges, start, 3)
    return got.select(F.floor(F.col("node") / 20).alias("f"), F.col("hops").cast("bigint").alias("hops")).groupBy("f", "hops").agg(F.count("*").alias("nodes"))


@query(f"SELECT 'src/m' || f || 'x.py' AS path, t AS test FROM (SELECT DISTINCT f, unnest(['tests/test_m' || f || 'x.py', 'src/m' || f || 'x_test.py', 'tests/deep/am' || f || 'xb.py']) AS t FROM {PARTS} p) d")
def related_tests(spark, sf):
    """Tests of each file by name or folder."""
    f = parts(spark, sf).select("f").distinct()
    every = f.select(F.explode(F.array(fmt("src/m%dx.py", "f"), fmt("tests/test_m%dx.py", "f"), fmt("src/m%dx_test.py", "f"), fmt("tests/deep/am%dxb.py", "f"), fmt("src/am%dxb.py", "f"))).alias("path"))
    return files_of.related_tests(f.select(fmt("src/m%dx.py", "f").alias("path")), every)


@query(f"SELECT part, n, line FROM (SELECT 'languages' AS part, 1::BIGINT AS n, 'python: ' || count(*) || ' files, ' || sum(l) || ' lines, ' || sum(t) || ' tokens (100.0%)' AS line FROM (SELECT f, count(*) AS l, greatest(1, length(string_agg('line ' || pk, chr(10))) // 4) AS t FROM {PARTS} p GROUP BY f) d) a UNION ALL SELECT 'entry points', row_number() OVER (ORDER BY path), path FROM (SELECT DISTINCT 'f' || f || '/main.py' AS path FROM {PARTS} p ORDER BY path LIMIT 8) b")
def project_digest(spark, sf):
    """A project in a few lines: languages and entry points."""
    docs = _docs(spark, sf).select(F.concat("path", F.lit("/main.py")).alias("path"), "text")
    return symbols.project_digest(docs, symbols.symbols_of(docs.limit(0))).where("part <> 'tree'")


@query(f"SELECT 'stats' AS item, 0::BIGINT AS n, count(*)::VARCHAR AS content, NULL::VARCHAR AS error FROM {DOCS} d UNION ALL SELECT 'first', 0, min(path), NULL FROM {DOCS} d UNION ALL SELECT 'missing', 0, NULL, 'KeyError: ''no such read'''")
def batch_read(spark, sf):
    """Several reads at once; one that fails is its error."""
    docs = _docs(spark, sf)
    return analyses.batch_read({"stats": docs.agg(F.count("*").cast("string").alias("content")), "first": docs.agg(F.min("path").alias("content")), "missing": KeyError("no such read")})


def _surfaces(spark, sf, side: int):
    """Two versions of a schema: of the newer one every third part is gone and every fifth has another type."""
    p = parts(spark, sf).where(F.col("pk") % 3 != side)
    kind = F.when((F.col("pk") % 5 == 0) & F.lit(side == 0), "TEXT").otherwise("INT")
    return listed(p, ["f"], ["pk"], F.concat(fmt("  c%d ", "pk"), kind), ",\n"), p


_CHANGE = f"SELECT f, 'c' || pk AS name, CASE WHEN pk % 3 = 0 THEN 'removed' WHEN pk % 3 = 1 THEN 'added' ELSE 'modified' END AS change FROM {PARTS} p WHERE pk % 3 <> 2 OR pk % 5 = 0"


@query(_CHANGE)
def diff_sql_schemas(spark, sf):
    """Columns of tables added, removed or of another type between two versions."""
    side = lambda s: parsed(wrapped(_surfaces(spark, sf, s)[0], "CREATE TABLE IF NOT EXISTS t (\n", "\n);"), ["f"], X.db_schema, X.MEMBERS).select("f", "type", "name", "detail")
    return relations.schema_diff(side(1), side(0), ["f", "type", "name"], ["detail"]).select("f", "name", "change")


@query(_CHANGE.replace("'c' ||", "'/p' ||"))
def diff_openapi(spark, sf):
    """Endpoints added, removed or changed between two versions."""

    def side(s):
        p = parts(spark, sf).where(F.col("pk") % 3 != s)
        text = wrapped(listed(p, ["f"], ["pk"], fmt("  /p%d:\n    get:\n      summary: %s", "pk", F.when((F.col("pk") % 5 == 0) & F.lit(s == 0), "new").otherwise("old"))), "paths:\n")
        return parsed(text, ["f"], X.openapi, X.MEMBERS).where("name = 'summary'").select("f", F.col("type").alias("name"), F.col("kind").alias("method"), "detail")

    return relations.schema_diff(side(1), side(0), ["f", "name", "method"], ["detail"]).select("f", "name", "change")


@query(_CHANGE.replace("'c' ||", "'C' ||"))
def diff_exports(spark, sf):
    """Exported names added, removed or of another kind between two versions."""

    def side(s):
        p = parts(spark, sf).where(F.col("pk") % 3 != s)
        line = F.when((F.col("pk") % 5 == 0) & F.lit(s == 0), fmt("export interface C%d {\n}", "pk")).otherwise(fmt("export class C%d {\n}", "pk"))
        return parsed(listed(p, ["f"], ["pk"], line), ["f"], X.api_surface("ts"), X.API).select("f", "name", "kind")

    return relations.schema_diff(side(1), side(0), ["f", "name"], ["kind"]).select("f", "name", "change")


# --- web, search, security


@query(f"""SELECT user_id, event_id, CASE WHEN before IS NULL THEN 'full' WHEN before = event_type THEN 'unchanged' ELSE 'diff' END AS state, CASE WHEN before IS NULL THEN repeat('the same line' || chr(10), 30) || event_type WHEN before = event_type THEN ''
ELSE '--- ' || chr(10) || '+++ ' || chr(10) || '@@ -29,3 +29,3 @@' || chr(10) || ' the same line' || chr(10) || ' the same line' || chr(10) || '-' || before || chr(10) || '+' || event_type END AS answer FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) e""")
def ledger_diffs(spark, sf):
    """What a read ledger answers: the text, that it is unchanged, or the diff."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.concat(F.repeat(F.lit("the same line\n"), 30), "event_type").alias("text"))
    return delta.answers(e, ["user_id"], ["event_id"], "text")


@query(f"SELECT f, '# Part ' || f || chr(10) || chr(10) || string_agg('- **p' || pk || '** [go](/' || size || ')', chr(10) ORDER BY pk) AS markdown FROM {PARTS} p GROUP BY f")
def page_markdown(spark, sf):
    """Pages as Markdown; their head may lack its end tag."""
    from granary.sources import web

    items_ = listed(parts(spark, sf), ["f"], ["pk"], fmt('<li><b>p%d</b> <a href="/%d">go</a></li>', "pk", "size"), "")
    pages = wrapped(items_, F.concat(F.when(F.col("f") % 2 == 0, "<html><head><title>x</title><body>").otherwise("<html><head><title>x</title></head><body>"), fmt("<script>no()</script><h1>Part %d</h1><ul>", "f")), "</ul></body></html>")
    return web.html_to_markdown(pages, "text").select("f", "markdown")


@query(f"SELECT page_id, count(*) AS headings FROM {PAGE_H} h GROUP BY page_id")
def page_sections(spark, sf):
    """The sections of each page's Markdown."""
    from granary.sources import web

    marked = web.html_to_markdown(table(spark, sf, "pages").select("page_id", "html"))
    return X.rows_of(marked, ["page_id"], "markdown", X.markdown_headings, X.HEADINGS).where("error is null").groupBy("page_id").agg(F.count("*").alias("headings"))


@query("SELECT vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) DESC, vec_id LIMIT 10")
def semantic_search(spark, sf):
    """The ten vectors nearest to the first, exactly."""
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    return analyses.top_cosine(table(spark, sf, "embeddings"), "vec_id", "embedding", list(row[0]), 10).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH l AS {LINES} SELECT line_level AS level, n FROM (SELECT CASE WHEN regexp_matches(trim(line), '^(//|#|\\*|/\\*)') THEN 'comment' WHEN contains(line, 'token = "') THEN 'token' ELSE 'other' END AS line_level, count(*) AS n FROM l GROUP BY 1) x""")
def secret_lines(spark, sf):
    """Lines by what the secret scan makes of them first."""
    c = F.col("line")
    kind = F.when(F.trim(c).rlike(r"^(//|#|\*|/\*)"), "comment").when(F.contains(c, F.lit('token = "')), "token").otherwise("other")
    return doc_lines(spark, sf).groupBy(kind.alias("level")).agg(F.count("*").alias("n"))


RULE_LINES = [
    ('let q = format!("SELECT {}");', "injection", "high", "high"), ("el.innerHTML = x{};", "xss", "high", "high"), ("unsafe {{ p{} }}", "unsafe", "medium", "medium"), ("x = detect_ecosystem({})", None, None, None),
    ("password = \"p{}\"", "secrets", "critical", "high"), ("// eval({})", None, None, None), ("y = eval({}) // ignore-security", None, None, None), ('s = "call eval({}) here"', None, None, None),
]


def _ruled_texts(spark, sf):
    line = F.lit(None).cast("string")
    for i, (shape, *_) in enumerate(RULE_LINES):
        line = F.when(F.col("pk") % len(RULE_LINES) == i, fmt(shape.replace("{{", "{").replace("}}", "}").replace("{}", "%d"), "pk")).otherwise(line)
    docs = listed(parts(spark, sf), ["f"], ["pk"], line)
    docs = docs.withColumn("text", F.when(F.col("f") % 4 == 3, F.concat(F.lit("# ignore-security-scan\n"), "text")).when(F.col("f") % 4 == 2, F.concat(F.lit("#[cfg(test)]\n"), "text")).otherwise(F.col("text")))
    return docs.select(F.col("f").alias("doc"), "text")


_RULED = ", ".join("(" + ", ".join([str(i), *["NULL" if x is None else repr(x) for x in r[1:]]]) + ")" for i, r in enumerate(RULE_LINES))
FOUND = f"(SELECT f, i, c AS category, s AS severity, k AS confidence FROM {PARTS} p JOIN (VALUES {_RULED}) v(m, c, s, k) ON pk % {len(RULE_LINES)} = m WHERE c IS NOT NULL AND f % 4 < 2)"


@query(f"SELECT f AS doc, i + 1 AS line_no, category, severity, confidence FROM {FOUND} x")
def security_surface(spark, sf):
    """Findings of the rules; quoted ones, comments, markers and test modules give none."""
    return analyses.security_surface(_ruled_texts(spark, sf), ["doc"]).select("doc", "line_no", "category", "severity", "confidence")


@query(" UNION ALL ".join(f"SELECT '{c}' AS by, {c} AS value, count(*) AS n FROM {FOUND} x GROUP BY {c}" for c in ("category", "severity", "confidence")))
def security_rollup(spark, sf):
    """All findings by category, severity and confidence."""
    return analyses.rollup(analyses.security_surface(_ruled_texts(spark, sf), ["doc"]))


_KW_LINE = " + ".join(f"least((length(lower(line)) - length(replace(lower(line), '{k}', ''))) // {len(k)}, 3)" for k in KW)


@query(f"""WITH RECURSIVE best AS (SELECT doc_id FROM (SELECT doc_id, {KW_SQL} AS score FROM (SELECT doc_id, lower(text) AS x FROM documents) a) b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 8),
c AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id, line_no) AS n, cost FROM (SELECT doc_id, line_no, {_KW_LINE} AS score, {est('line')} AS cost FROM {LINES} l WHERE doc_id IN (SELECT doc_id FROM best)) x WHERE score > 0),
f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS taken, 0::BIGINT AS omitted UNION ALL SELECT c.n, CASE WHEN used + cost <= 2000 THEN used + cost ELSE used END, taken + CASE WHEN used + cost <= 2000 THEN 1 ELSE 0 END, omitted + CASE WHEN used + cost <= 2000 THEN 0 ELSE 1 END FROM f JOIN c ON c.n = f.n + 1)
SELECT 'license' AS query, taken::INTEGER AS taken, used, omitted FROM f WHERE n > 0 ORDER BY n DESC LIMIT 1""")
def context_pack(spark, sf):
    """Lines of the best documents, filled into 2000 tokens: one that does not fit is left out and the next is tried."""
    docs = table(spark, sf, "documents").select("doc_id", "text", T.score_text(F.lower("text"), KW, 20).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(8)
    part = lines.explode_lines(docs, ["doc_id"]).withColumn("rank", -T.score_text(F.lower("line"), KW, 3)).where("rank < 0")
    costs = part.withColumn("cost", T.est_tokens("line"))
    return analyses.budget_fill(costs.withColumn("query", F.lit("license")), ["query"], ["rank", "doc_id", "line_no"], "cost", 2000).select("query", F.size("taken").alias("taken"), "used", "omitted")


@query(f"SELECT f, 'notes' AS anchor, 'Notes' AS title, '## Notes' || chr(10) || chr(10) || 'of ' || f || chr(10) AS content FROM (SELECT DISTINCT f FROM {PARTS} p) d")
def page_section_bodies(spark, sf):
    """A section of each page's Markdown."""
    from granary.sources import web

    pages = parts(spark, sf).select("f").distinct().withColumn("html", fmt("<body><h1>Top</h1><p>x</p><h2>Notes</h2><p>of %d</p><h2>More</h2><p>y</p>", "f"))
    return web.page_sections(pages, ["f"], ["notes", "none"]).select("f", "anchor", "title", "content")


@query(f"SELECT f, '## HEAD' || chr(10) || chr(10) || 'Part ' || f || ' (x)' AS markdown FROM (SELECT DISTINCT f FROM {PARTS} p) d WHERE f % 3 <> 2 UNION ALL SELECT DISTINCT f, NULL FROM {PARTS} p WHERE f % 3 = 2")
def convert_documents(spark, sf):
    """PDF files as Markdown; what is no document gives nothing."""
    from granary.sources import web

    head = "%%PDF-1.4\n4 0 obj\n<< /Length 9 >>\nstream\nBT /F1 12 Tf 72 720 Td (HEAD) Tj 0 -14 Td "
    files = parts(spark, sf).select("f").distinct().withColumn("content", F.when(F.col("f") % 3 == 2, "none").when(F.col("f") % 3 == 0, fmt(head + "(Part %d \\(x\\)) Tj ET\nendstream", "f")).otherwise(fmt(head + "[(Part ) -20 (%d) <20287829>] TJ ET\nendstream", "f")).cast("binary"))
    return web.convert_documents(files).select("f", "markdown")


# --- streams


def _event_stream(spark, sf):
    from granary.plans.relational import _stream

    return _stream(spark, sf, "events")


@query("SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf):
    """Events as a stream, joined with a table."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return ledger.drained(ledger.with_dimension(_event_stream(spark, sf).select("event_id", "user_id"), c, "user_id"))


@query("""WITH r AS (SELECT conv_id, turn, list(DISTINCT role) AS now FROM conversations GROUP BY 1, 2), l AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY conv_id ORDER BY turn), []) AS before FROM r)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(before, x))), ',') AS new, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(now, x))), ',') AS resolved, array_to_string(list_sort(list_filter(now, lambda x: list_contains(before, x))), ',') AS unchanged FROM l""")
def stream_run_delta(spark, sf):
    """Roles of each turn against the turn before, as a stream run to its end."""
    from granary.plans.relational import _stream

    s = _stream(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("messages"))
    got = ledger.drained(ledger.run_delta(s, "conv_id", "turn", "messages", keep_ms=None))
    return got.select("conv_id", "turn", *[F.array_join(c, ",").alias(c) for c in ("new", "resolved", "unchanged")])


# --- dashboards


@query("SELECT tool, calls, errors, tokens, tokens * 669 // 100 AS tokens_saved FROM (SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_id % 7 = 0) AS errors, sum(event_id % 100)::BIGINT AS tokens FROM events GROUP BY 1) x")
def dashboard(spark, sf):
    """Calls, errors, tokens used and saved by tool."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("tool"), (F.col("event_id") % 7 != 0).alias("success"), F.lit(0).alias("duration_ms"), (F.col("event_id") % 100).alias("token_count"))
    return stats.dashboard(e).select("tool", "calls", "errors", "tokens", "tokens_saved")


@query(f"SELECT o AS diff, 'o' || o AS path, sum(q)::BIGINT AS added, sum(ln)::BIGINT AS deleted FROM {ITEMS} i GROUP BY o ORDER BY sum(q) + sum(ln) DESC, 'o' || o LIMIT 10")
def pr_files(spark, sf):
    """The ten largest files of a change."""
    stat = items(spark, sf).select("o", fmt("o%d", "o").alias("path"), F.col("q").alias("added"), F.col("ln").alias("deleted"))
    empty = spark.createDataFrame([], "path string, status string")
    none = spark.createDataFrame([], "sha string, author string, date string, subject string")
    top, _, _ = history.pr_context(stat.drop("o"), empty, stat.select("path"), none)
    return top.select(F.substring("path", 2, 30).cast("bigint").alias("diff"), "path", "added", "deleted")
