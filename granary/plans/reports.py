"""Queries that write reports, manifests, sources and logs from the tables, read them back with the parsers, and compare with the tables.

Each text is written for a key of few rows (an order, twenty parts, ten events), so none grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import analyses, history, lines, relations, symbols
from granary.plans.corpus import est
from granary.plans.registry import query, register, table
from granary.session import spread, written
from granary.sources import extract as X


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def listed(df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str = "\n", together: bool = False) -> DataFrame:
    """(keys…, text): the lines of each key in order, joined; texts are spread, unless a key's rows are together, since what reads them works long on few bytes."""
    return (df if together else spread(df, *keys)).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), sep).alias("text"))


def wrapped(df: DataFrame, before: Column | str, after: Column | str = "") -> DataFrame:
    part = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.withColumn("text", F.concat(part(before), F.col("text"), part(after)))


def items(spark, sf) -> DataFrame:
    """Line items as (o, ln, pk, sk, q, flag)."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("flag"))


def parts(spark, sf) -> DataFrame:
    """Parts as (f, pk, size), f being twenty parts."""
    return table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("f"), F.col("p_partkey").alias("pk"), F.col("p_size").cast("bigint").alias("size"), F.col("p_brand").alias("brand"))


def errors(spark, sf) -> DataFrame:
    """Error events as (b, id, u), b being ten events."""
    return table(spark, sf, "events").where("event_type = 'error'").select(F.floor(F.col("event_id") / 10).alias("b"), F.col("event_id").alias("id"), F.col("user_id").alias("u"))


ITEMS = "(SELECT l_orderkey AS o, l_linenumber::BIGINT AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity::BIGINT AS q, l_returnflag AS flag FROM lineitem)"
PARTS = "(SELECT p_partkey // 20 AS f, p_partkey AS pk, p_size::BIGINT AS size, p_brand AS brand, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS i FROM part)"
ERRORS = "(SELECT event_id // 10 AS b, event_id AS id, user_id AS u FROM events WHERE event_type = 'error')"
fmt = F.format_string


def put(pattern: str, *values: Column | str) -> Column:
    """What ``format_string`` gives for %s of texts and %d of whole numbers, joined from its parts: a formatter reads its pattern anew for each row."""
    fixed = re.split("%[sd]", pattern)
    if any("%" in x for x in fixed) or len(fixed) != len(values) + 1:
        return F.format_string(pattern, *values)
    shown = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null")) for v in values]
    return F.concat(F.lit(fixed[0]), *[x for v, text in zip(shown, fixed[1:], strict=True) for x in (v, F.lit(text))])


def parsed(df: DataFrame, keys: list[str], parse, fields: str) -> DataFrame:
    return X.rows_of(df, keys, "text", parse, fields).where("error is null")


# --- coverage


def _lcov(spark, sf):
    text = wrapped(listed(items(spark, sf), ["o"], ["ln"], fmt("DA:%d,%d", "ln", F.col("q") % 3)), fmt("TN:\nSF:src/o%d.rs\n", "o"), "\nend_of_record")
    return parsed(text, ["o"], X.coverage("lcov"), X.LINES).select("file", *big("line_no"), "hit")


HITS = f"(SELECT 'src/o' || o || '.rs' AS file, ln AS line_no, q % 3 > 0 AS hit FROM {ITEMS} i)"


@query(f"SELECT file, line_no, hit FROM {HITS} h")
def coverage_lcov(spark, sf):
    """Instrumented lines of lcov reports."""
    return _lcov(spark, sf)


@query(f"SELECT file, line_no, bool_or(hit) AS hit FROM {HITS} h GROUP BY file, line_no")
def coverage_python(spark, sf):
    """Instrumented lines of coverage.py reports."""
    which = lambda hit: F.collect_list(F.when((F.col("q") % 3 > 0) == hit, F.col("ln")))
    by = items(spark, sf).groupBy("o").agg(which(True).alias("executed_lines"), which(False).alias("missing_lines"))
    text = by.select("o", F.to_json(F.struct(F.create_map(fmt("src/o%d.rs", "o"), F.struct("executed_lines", "missing_lines")).alias("files"))).alias("text"))
    return parsed(text, ["o"], X.coverage("coverage.py"), X.LINES).select("file", *big("line_no"), "hit")


@query(f"SELECT file, line_no, hit FROM {HITS} h")
def coverage_cobertura(spark, sf):
    """Instrumented lines of Cobertura reports."""
    text = wrapped(listed(items(spark, sf), ["o"], ["ln"], fmt('<line number="%d" hits="%d"/>', "ln", F.col("q") % 3)), fmt('<coverage><packages><package><classes><class filename="src/o%d.rs"><lines>', "o"), "</lines></class></classes></package></packages></coverage>")
    return parsed(text, ["o"], X.coverage("cobertura"), X.LINES).select("file", *big("line_no"), "hit")


@query(f"""WITH s AS (SELECT DISTINCT file, unnest(['low', 'high', 'late']) AS name, unnest([1, 4, 9])::BIGINT AS start, unnest([3, 8, 20])::BIGINT AS "end" FROM {HITS} h)
SELECT s.file, name, start, "end", count(line_no) FILTER (WHERE hit) AS covered, count(line_no) AS total, CASE WHEN count(line_no) = 0 THEN 100.0::DOUBLE ELSE floor((count(line_no) FILTER (WHERE hit))::DOUBLE / count(line_no)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE END AS pct
FROM s LEFT JOIN {HITS} h ON s.file = h.file AND line_no BETWEEN start AND "end" GROUP BY ALL""")
def coverage_of_symbols(spark, sf):
    """Covered and instrumented lines of each symbol; one without lines is covered."""
    hits = written(_lcov(spark, sf))
    spans = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for n, a, b in (("low", 1, 3), ("high", 4, 8), ("late", 9, 20))]))
    return relations.coverage(hits, spread(hits.select("file"), "file").distinct().select("file", spans))


@query(f"SELECT count(*) FILTER (WHERE hit) AS covered, count(*) AS total, floor((count(*) FILTER (WHERE hit))::DOUBLE / count(*)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS pct FROM {HITS} h")
def coverage_overall(spark, sf):
    """Covered and instrumented lines over all files."""
    return relations.overall_coverage(_lcov(spark, sf))


# --- history


def _exploded(df: DataFrame, keys: list[str]) -> DataFrame:
    return lines.explode_lines(df, keys)


@query("SELECT 'part' || l_partkey AS path, 'c' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, l_quantity::BIGINT AS added, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END::BIGINT AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def log_numstat(spark, sf):
    """Lines added and deleted by author and path, read from numstat logs; a binary count is zero."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), fmt("c%d", "o_custkey").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    rows = listed(items(spark, sf), ["o"], ["ln"], fmt("%d\t%s\tpart%d", "q", F.when(F.col("ln") % 3 == 0, "-").otherwise(F.col("ln").cast("string")), "pk")).join(o, "o")
    text = wrapped(rows, F.concat(F.lit("\x1e"), "author", F.lit("\x1f"), "date", F.lit("\n\n")))
    return history.parse_numstat(_exploded(text.withColumnRenamed("o", "log"), ["log"])).select("path", "author", "date", "added", "deleted")


def _diffs(spark, sf):
    body = F.concat(fmt("@@ -%d +%d @@ fn f%s()\n+new %d", "ln", "ln", "flag", "pk"), F.when(F.col("ln") % 2 == 0, fmt("\n-old %d", "sk")).otherwise(F.lit("")))
    text = listed(items(spark, sf), ["o"], ["ln", "pk", "sk"], body)
    state = F.when(F.col("o") % 5 == 0, "new file mode 100644\n").when(F.col("o") % 5 == 1, "deleted file mode 100644\n").otherwise("")
    text = wrapped(text, F.concat(fmt("diff --git a/o%d.rs b/o%d.rs\n", "o", "o"), state, fmt("--- a/o%d.rs\n+++ b/o%d.rs\n", "o", "o")))
    return history.parse_diff(_exploded(text.withColumnRenamed("o", "diff"), ["diff"]))


@query(f"""SELECT o AS diff, kind, n FROM (SELECT o, count(*) AS hunk, count(*) AS added, count(*) FILTER (WHERE ln % 2 = 0) AS deleted, CASE WHEN o % 5 IN (0, 1) THEN 1 ELSE 0 END AS status, 3 AS other FROM {ITEMS} i GROUP BY o) s UNPIVOT (n FOR kind IN (hunk, added, deleted, status, other)) WHERE n > 0""")
def diff_lines(spark, sf):
    """Lines of unified diffs by what they are."""
    return _diffs(spark, sf).groupBy("diff", "kind").agg(F.count("*").alias("n"))


@query(f"""SELECT o AS diff, 'o' || o || '.rs' AS path, CASE o % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status, 'fn f' || flag || '()' AS symbol, count(*) AS n_hunk, count(*) AS n_added, count(*) FILTER (WHERE ln % 2 = 0) AS n_deleted FROM {ITEMS} i GROUP BY o, flag""")
def structural_diff(spark, sf):
    """Hunks, lines added and deleted by file and enclosing symbol, read from unified diffs."""
    return history.diff_zoom(_diffs(spark, sf), "skeleton")


@query(f"""SELECT o AS diff, count(*) + 1 + CASE WHEN o % 5 IN (0, 1) THEN 1 ELSE 0 END AS n FROM {ITEMS} i GROUP BY o""")
def diff_sketch(spark, sf):
    """Header lines of unified diffs."""
    return history.diff_zoom(_diffs(spark, sf), "sketch").groupBy("diff").agg(F.count("*").alias("n"))


@query(f"SELECT o AS blame, ln AS at, substr(sha256('s' || pk), 1, 7) AS sha7, 'a' || pk % 7 AS author, strftime(make_timestamp((pk * 86400 * 1000000)::BIGINT), '%Y-%m-%d') AS date, 'line ' || sk AS content FROM (SELECT * FROM {ITEMS} i QUALIFY count(*) OVER (PARTITION BY o, ln) = 1) u")
def blame_body(spark, sf):
    """Lines with their commit, author and date, read from porcelain blame; what is known of a commit stands at its first line only."""
    from pyspark.sql import Window

    one = spread(items(spark, sf), "o").withColumn("k", F.count("*").over(Window.partitionBy("o", "ln"))).where("k = 1").withColumn("first", F.row_number().over(Window.partitionBy("o", "pk").orderBy("ln")) == 1)
    sha = F.substring(F.sha2(F.concat(F.lit("s"), F.col("pk").cast("string")).cast("binary"), 256), 1, 40)
    known = F.when(F.col("first"), fmt("author a%d\nauthor-mail <x>\nauthor-time %d\n", F.col("pk") % 7, F.col("pk") * 86400)).otherwise(F.lit(""))
    text = listed(one, ["o"], ["ln"], F.concat(sha, fmt(" 1 %d 1\n", "ln"), known, fmt("\tline %d", "sk")), together=True)
    return history.parse_blame(_exploded(text.withColumnRenamed("o", "blame"), ["blame"]))


@query("""SELECT o_orderkey AS index, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE o_orderkey % 3 WHEN 0 THEN 'WIP on b' || o_custkey || ': x' WHEN 1 THEN 'On topic: y: z' ELSE 'note' END AS message, CASE o_orderkey % 3 WHEN 0 THEN 'b' || o_custkey WHEN 1 THEN 'topic' ELSE 'unknown' END AS branch FROM orders""")
def stash_list(spark, sf):
    """Stashes with their branch, read from a listing."""
    message = F.when(F.col("o_orderkey") % 3 == 0, fmt("WIP on b%d: x", "o_custkey")).when(F.col("o_orderkey") % 3 == 1, "On topic: y: z").otherwise("note")
    return history.parse_stash(table(spark, sf, "orders").select(F.concat_ws("\x1f", fmt("stash@{%d}", "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), message).alias("line")))


@query("""SELECT o_orderkey AS log, substr(sha256('c' || o_orderkey), 1, 7) AS sha7, 'c' || o_custkey || '@x.org' AS email, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority || ' | more' AS subject, coalesce(files, '') AS files FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, string_agg('p' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS files FROM lineitem GROUP BY 1) f USING (o_orderkey)""")
def log_commits(spark, sf):
    """Commits with their files in order, read from logs."""
    names = listed(items(spark, sf), ["o"], ["ln", "pk"], fmt("p%d", "pk"))
    o = table(spark, sf, "orders")
    sha = F.substring(F.sha2(fmt("c%d", "o_orderkey").cast("binary"), 256), 1, 40)
    head = F.concat(F.lit("COMMIT:"), F.concat_ws("|", sha, fmt("c%d@x.org", "o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat("o_orderpriority", F.lit(" | more"))))
    text = o.select(F.col("o_orderkey").alias("o"), head.alias("head")).join(names, "o", "left").select(F.col("o").alias("log"), F.concat("head", F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return history.parse_log(_exploded(text, ["log"])).select("log", "sha7", "email", "date", "subject", F.array_join("files", ",").alias("files"))


@query("""SELECT count(*) AS files, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM (SELECT sum(l_quantity::BIGINT) AS added, sum(l_linenumber) AS deleted FROM lineitem GROUP BY l_orderkey) s""")
def changed_totals(spark, sf):
    """Changed files and their lines in all."""
    from granary.plans.relational import changed_files

    return history.changed_totals(changed_files(spark, sf))


# --- audits and diagnostics


SEVERITIES = "['critical', 'high', 'moderate', 'low']"


def _severity(id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "moderate", "low")]), (id % 4 + 1).cast("int"))


def _found(df):
    return df.select("package", "severity", "id", "affected", "patched", "title")


@query(f"SELECT 'pkg' || id AS package, {SEVERITIES}[id % 4 + 1] AS severity, 'u/' || id AS id, '<' || u AS affected, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'fix available' ELSE u || '.0' END AS patched, 'title ' || id AS title FROM {ERRORS} e")
def audit_npm(spark, sf):
    """Findings of npm audits."""
    fix = F.when(F.col("id") % 3 == 0, "false").when(F.col("id") % 3 == 1, "true").otherwise(fmt('{"version":"%d.0"}', "u"))
    line = fmt('"pkg%d":{"severity":"%s","via":["other",{"url":"u/%d","title":"title %d"}],"range":"<%d","fixAvailable":%s}', "id", _severity(F.col("id")), "id", "id", "u", fix)
    return _found(parsed(wrapped(listed(errors(spark, sf), ["b"], ["id"], line, ","), '{"vulnerabilities":{', "}}"), ["b"], X.audit("npm"), X.FINDINGS))


CVSS = "CASE WHEN s >= 90 THEN 'critical' WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'moderate' WHEN s > 0 THEN 'low' ELSE 'unknown' END"


@query(f"SELECT 'p' || id AS package, {CVSS} AS severity, 'R-' || id AS id, '1.' || u AS affected, CASE WHEN id % 2 = 0 THEN '>=2, >=1.' || u END AS patched, 'title ' || id AS title FROM (SELECT *, id % 101 AS s FROM {ERRORS} e) x")
def audit_cargo(spark, sf):
    """Findings of cargo audits, their severity by score."""
    line = fmt('{"advisory":{"id":"R-%d","cvss":"%s","title":"title %d"},"package":{"name":"p%d","version":"1.%d"},"versions":{"patched":[%s]}}', "id", ((F.col("id") % 101) / 10).cast("string"), "id", "id", "u", F.when(F.col("id") % 2 == 0, fmt('">=2",">=1.%d"', "u")).otherwise(F.lit("")))
    return _found(parsed(wrapped(listed(errors(spark, sf), ["b"], ["id"], line, ","), '{"vulnerabilities":{"list":[', "]}}"), ["b"], X.audit("cargo"), X.FINDINGS))


@query(f"SELECT 'p' || id AS package, 'unknown' AS severity, 'PY-' || id AS id, '1.' || u AS affected, CASE WHEN id % 2 = 0 THEN '2.0, 3.' || u END AS patched, 'text ' || id AS title FROM {ERRORS} e")
def audit_pip(spark, sf):
    """Findings of pip audits, as an object or a bare array."""
    line = fmt('{"name":"p%d","version":"1.%d","vulns":[{"id":"PY-%d","fix_versions":[%s],"description":"text %d"}]}', "id", "u", "id", F.when(F.col("id") % 2 == 0, fmt('"2.0","3.%d"', "u")).otherwise(F.lit("")), "id")
    bare = listed(errors(spark, sf), ["b"], ["id"], line, ",").withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    text = bare.withColumn("text", F.when(F.col("b") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit('{"dependencies":'), "text", F.lit("}"))))
    return _found(parsed(text, ["b"], X.audit("pip"), X.FINDINGS))


@query(f"SELECT 'p' || id AS package, {CVSS} AS severity, 'O-' || id || x AS id, '1.' || u AS affected, NULL::VARCHAR AS patched, 'sum ' || x AS title FROM (SELECT *, id % 101 AS s, unnest(['a', 'b']) AS x FROM {ERRORS} e) y")
def audit_osv(spark, sf):
    """Findings of OSV scans; the first group's severity is the package's."""
    line = fmt('{"package":{"name":"p%d","version":"1.%d"},"groups":[{"max_severity":"%s"}],"vulnerabilities":[{"id":"O-%da","summary":"sum a"},{"id":"O-%db","summary":"sum b"}]}', "id", "u", ((F.col("id") % 101) / 10).cast("string"), "id", "id")
    return _found(parsed(wrapped(listed(errors(spark, sf), ["b"], ["id"], line, ","), '{"results":[{"packages":[', "]}]}"), ["b"], X.audit("osv"), X.FINDINGS))


def _diagnosed(df):
    return df.select("file", *big("line", "col"), "severity", "code", "message")


LEVEL = "CASE WHEN q % 2 = 0 THEN 'error' ELSE 'warning' END"
def _level() -> Column:
    return F.when(F.col("q") % 2 == 0, "error").otherwise("warning")


def _tsc(spark, sf):
    text = listed(items(spark, sf), ["o"], ["ln", "pk"], put("src/o%d.ts(%d,%d): %s TS%d: part %d (x): no", "o", "ln", "q", _level(), "sk", "pk"))
    return _diagnosed(parsed(wrapped(text, "noise\n"), ["o"], X.diagnostics("tsc"), X.DIAGNOSTICS))


TSC = f"(SELECT 'src/o' || o || '.ts' AS file, ln AS line, q AS col, {LEVEL} AS severity, 'TS' || sk AS code, 'part ' || pk || ' (x): no' AS message FROM {ITEMS} i)"


@query(f"SELECT * FROM {TSC} t")
def diagnostics_tsc(spark, sf):
    """Findings of the TypeScript compiler."""
    return _tsc(spark, sf)


@query(f"SELECT 'src/o' || o || '.py' AS file, ln AS line, CASE WHEN q % 3 = 0 THEN 0 ELSE q END AS col, CASE q % 3 WHEN 1 THEN 'hint' ELSE 'error' END AS severity, CASE WHEN q % 2 = 0 THEN 'kind-' || sk END AS code, 'part ' || pk AS message FROM {ITEMS} i")
def diagnostics_mypy(spark, sf):
    """Findings of mypy, with and without column and code."""
    line = F.concat(put("src/o%d.py:%d:", "o", "ln"), F.when(F.col("q") % 3 == 0, "").otherwise(put("%d:", "q")), F.when(F.col("q") % 3 == 1, " note: ").otherwise(" error: "), put("part %d", "pk"), F.when(F.col("q") % 2 == 0, put("  [kind-%d]", "sk")).otherwise(""))
    return _diagnosed(parsed(listed(items(spark, sf), ["o"], ["ln", "pk"], line), ["o"], X.diagnostics("mypy"), X.DIAGNOSTICS))


@query(f"SELECT 'o' || o || '.go' AS file, ln AS line, CASE WHEN q % 2 = 0 THEN q ELSE 0 END AS col, 'error' AS severity, NULL::VARCHAR AS code, 'part ' || pk || ' wrong' AS message FROM {ITEMS} i")
def diagnostics_govet(spark, sf):
    """Findings of go vet."""
    line = F.concat(put("vet: o%d.go:%d:", "o", "ln"), F.when(F.col("q") % 2 == 0, put("%d:", "q")).otherwise(""), put(" part %d wrong", "pk"))
    return _diagnosed(parsed(wrapped(listed(items(spark, sf), ["o"], ["ln", "pk"], line), "# pkg\n"), ["o"], X.diagnostics("govet"), X.DIAGNOSTICS))


@query(f"SELECT 'o' || o || '.py' AS file, ln AS line, q AS col, {LEVEL} AS severity, 'rule' || sk AS code, 'part ' || pk || ' x' AS message FROM {ITEMS} i")
def diagnostics_pyright(spark, sf):
    """Findings of pyright, whose lines and columns count from zero."""
    line = put('{"file":"o%d.py","severity":"%s","rule":"rule%d","message":"part %d\\nx","range":{"start":{"line":%d,"character":%d}}}', "o", _level(), "sk", "pk", F.col("ln") - 1, F.col("q") - 1)
    return _diagnosed(parsed(wrapped(listed(items(spark, sf), ["o"], ["ln", "pk"], line, ","), '{"generalDiagnostics":[', "]}"), ["o"], X.diagnostics("pyright"), X.DIAGNOSTICS))


@query(f"SELECT 'o' || o || '.rs' AS file, ln AS line, q AS col, CASE q % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'hint' END AS severity, CASE WHEN q % 2 = 0 THEN 'E' || sk END AS code, 'part ' || pk AS message FROM {ITEMS} i")
def diagnostics_cargo(spark, sf):
    """Findings of cargo check, at the primary place; notes and help are hints, trailers go."""
    level = F.when(F.col("q") % 3 == 0, "error").when(F.col("q") % 3 == 1, "warning").otherwise("note")
    line = put('{"reason":"compiler-message","message":{"level":"%s","message":"part %d","code":%s,"spans":[{"file_name":"other.rs","line_start":1,"column_start":1,"is_primary":false},{"file_name":"o%d.rs","line_start":%d,"column_start":%d,"is_primary":true}]}}', level, "pk", F.when(F.col("q") % 2 == 0, put('{"code":"E%d"}', "sk")).otherwise("null"), "o", "ln", "q")
    text = wrapped(listed(items(spark, sf), ["o"], ["ln", "pk"], line), '{"reason":"compiler-artifact"}\n   Checking x\n', '\n{"reason":"compiler-message","message":{"level":"error","message":"aborting due to 2 previous errors","code":null,"spans":[]}}')
    return _diagnosed(parsed(text, ["o"], X.diagnostics("cargo"), X.DIAGNOSTICS))


@query(f"SELECT DISTINCT * FROM {TSC} t ORDER BY CASE severity WHEN 'error' THEN 3 ELSE 2 END DESC, file, line, col, message, code LIMIT 100")
def diagnostics_report(spark, sf):
    """The hundred findings that matter most, each once."""
    return analyses.diagnostics_rank(_tsc(spark, sf))


@query(f"SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, 0::BIGINT AS hints, count(*) AS total, least(count(*), 100) AS shown FROM (SELECT DISTINCT * FROM {TSC} t) s")
def diagnostics_summary(spark, sf):
    """Findings by severity, before and after the cut."""
    return analyses.diagnostics_summary(_tsc(spark, sf))


# --- packages and pipelines


def _manifest(name: str, doc: str, sql: str, text):
    def run(spark, sf):
        return parsed(text(parts(spark, sf)), ["f"], X.manifest(name), X.PACKAGES).select("f", "name", "version", "kind")

    register("manifest_" + name.split(".")[0].lower().replace("-", "_") if name != "build.gradle" else "manifest_gradle", run, f"SELECT f, name, version, kind FROM ({sql.replace('PARTS', PARTS)}) s", doc)


def _two(df: DataFrame, dev: Column, run: Column, join: Column) -> DataFrame:
    """Texts of two sections: the lines of parts with even keys, and of the others."""
    even = F.col("pk") % 2 == 0
    by = lambda c, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pk", line.alias("l"))))), lambda x: x["l"]), "SEP")
    return df.groupBy("f").agg(by(even, dev).alias("dev"), by(~even, run).alias("run")).withColumn("text", join).drop("dev", "run")


def _sections(a: str, b: str, sep: str, end: str = "") -> Column:
    return F.concat(F.lit(a), F.replace("run", F.lit("SEP"), F.lit(sep)), F.lit(b), F.replace("dev", F.lit("SEP"), F.lit(sep)), F.lit(end))


_manifest("package.json", "Dependencies of package.json files.", "SELECT f, 'p' || pk AS name, '^' || size || '.0' AS version, CASE WHEN pk % 2 = 0 THEN 'dev' ELSE 'runtime' END AS kind FROM PARTS p", lambda p: _two(p, *[fmt('"p%d":"^%d.0"', "pk", "size")] * 2, _sections('{"name":"x","dependencies":{', '},"devDependencies":{', ",", "}}")))
_manifest("Cargo.toml", "Dependencies of Cargo manifests; a table without a version is any.", "SELECT f, 'p' || pk AS name, CASE WHEN pk % 2 = 0 THEN '*' ELSE size || '.0' END AS version, CASE WHEN pk % 2 = 0 THEN 'build' ELSE 'runtime' END AS kind FROM PARTS p", lambda p: _two(p, fmt('p%d = { path = "x" }', "pk"), fmt('p%d = "%d.0"', "pk", "size"), _sections('[package]\nname = "x"\n[dependencies]\n', "\n[build-dependencies]\n", "\n")))
_manifest("pyproject.toml", "Dependencies of pyproject files.", "SELECT f, 'p' || pk AS name, '>=' || size AS version, CASE WHEN pk % 2 = 0 THEN 'dev' ELSE 'runtime' END AS kind FROM PARTS p", lambda p: _two(p, fmt('"p%d >=%d"', "pk", "size"), fmt('"p%d>=%d"', "pk", "size"), _sections('[project]\nname = "x"\ndependencies = [', "]\n[project.optional-dependencies]\ntests = [", ", ", "]\n")))
_manifest("requirements.txt", "Packages of requirements files.", "SELECT f, 'p' || pk AS name, CASE WHEN pk % 2 = 0 THEN '*' ELSE '==' || size END AS version, 'runtime' AS kind FROM PARTS p", lambda p: _two(p, fmt("p%d", "pk"), fmt("p%d==%d", "pk", "size"), _sections("# x\n-r other.txt\n", "\n\n", "\n")))
_manifest("go.mod", "Modules of go.mod files; indirect ones are optional.", "SELECT f, 'x.org/p' || pk AS name, 'v1.' || size || '.0' AS version, CASE WHEN pk % 2 = 0 THEN 'optional' ELSE 'runtime' END AS kind FROM PARTS p", lambda p: _two(p, fmt("require x.org/p%d v1.%d.0 // indirect", "pk", "size"), fmt("\tx.org/p%d v1.%d.0", "pk", "size"), _sections("module x\n\ngo 1.20\n\nrequire (\n", "\n)\n", "\n")))
_manifest("pom.xml", "Dependencies of POM files by scope.", "SELECT f, 'p' || pk AS name, CASE WHEN pk % 2 = 0 THEN '*' ELSE size || '.0' END AS version, CASE WHEN pk % 2 = 0 THEN 'dev' ELSE 'runtime' END AS kind FROM PARTS p", lambda p: _two(p, fmt("<dependency><groupId>g</groupId><artifactId>p%d</artifactId><scope>test</scope></dependency>", "pk"), fmt("<dependency>\n<groupId>g</groupId><artifactId>p%d</artifactId><version>%d.0</version>\n</dependency>", "pk", "size"), _sections("<project><artifactId>x</artifactId><version>1</version><dependencies>", "", "\n", "</dependencies></project>")))
_manifest("build.gradle", "Dependencies of Gradle files by configuration.", "SELECT f, 'g:p' || pk AS name, CASE WHEN pk % 2 = 0 THEN '*' ELSE size || '.0' END AS version, CASE WHEN pk % 2 = 0 THEN 'dev' ELSE 'runtime' END AS kind FROM PARTS p", lambda p: _two(p, fmt("    testImplementation('g:p%d')", "pk"), fmt('    implementation "g:p%d:%d.0"', "pk", "size"), _sections("dependencies {\n", "\n", "\n", "\n}")))


def _jobs(kind: str, sql: str, text):
    def run(spark, sf):
        return parsed(text(spark, sf), ["f"], X.pipeline(kind), X.JOBS).select("f", "job", "needs", *big("step"), "label", "env")

    register(f"ci_{kind}", run, f"SELECT f, job, needs, step, label, env FROM ({sql.replace('PARTS', PARTS)}) s", f"Jobs and steps of {kind} definitions.")


_jobs(
    "github",
    "SELECT f, 'build' AS job, 'lint' AS needs, i AS step, CASE pk % 3 WHEN 0 THEN 'Part ' || pk WHEN 1 THEN 'uses: a/b@v' || size ELSE 'run: make p' || pk END AS label, CASE WHEN pk % 3 = 2 THEN 'env.X,secrets.T' || pk ELSE '' END AS env FROM PARTS p",
    lambda spark, sf: wrapped(listed(parts(spark, sf), ["f"], ["pk"], F.when(F.col("pk") % 3 == 0, fmt('      - name: "Part %d"\n        run: x', "pk")).when(F.col("pk") % 3 == 1, fmt('      - uses: "a/b@v%d"', "size")).otherwise(fmt("      - run: |\n          make p%d\n          echo ${{ env.X }} ${{ secrets.T%d }}", "pk", "pk"))), "on: [push]\njobs:\n  build:\n    needs: lint\n    steps:\n"),
)
_jobs("gitlab", "SELECT f, 'build' AS job, '' AS needs, i AS step, 'make p' || pk AS label, '' AS env FROM PARTS p", lambda spark, sf: wrapped(listed(parts(spark, sf), ["f"], ["pk"], fmt("    - make p%d", "pk")), "stages: [a]\nvariables: {X: 1}\nbuild:\n  script:\n"))
_jobs("circleci", "SELECT f, 'build' AS job, 'lint' AS needs, i AS step, CASE WHEN pk % 2 = 0 THEN 'checkout' ELSE 'run' END AS label, '' AS env FROM PARTS p", lambda spark, sf: wrapped(listed(parts(spark, sf), ["f"], ["pk"], F.when(F.col("pk") % 2 == 0, F.lit("      - checkout")).otherwise(fmt("      - run: make p%d", "pk"))), "version: 2\nworkflows:\n  version: 2\n  all:\n    jobs:\n      - build: {requires: [lint]}\n      - absent\njobs:\n  build:\n    docker: [{image: x}]\n    steps:\n"))


# --- test results and outlines


OUTCOME = "CASE q % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END"


def _outcome(passed: str, failed: str, skipped: str) -> Column:
    return F.when(F.col("q") % 3 == 0, passed).when(F.col("q") % 3 == 1, failed).otherwise(skipped)


RESULT_TEXTS = {
    "pytest": lambda i: listed(i, ["o"], ["ln", "pk"], fmt("tests/s%d.py::t_%d %s [ 10%%]", "o", "pk", _outcome("PASSED", "ERROR", "XFAIL"))),
    "cargo": lambda i: wrapped(listed(i, ["o"], ["ln", "pk"], fmt("test t_%d ... %s", "pk", _outcome("ok", "FAILED", "ignored"))), fmt("     Running unittests tests/s%d.py (target/x)\n", "o"), "\ntest result: FAILED. 1 passed"),
    "jest": lambda i: wrapped(listed(i, ["o"], ["ln", "pk"], fmt("  %s t_%d (3 ms)", _outcome("✓", "✕", "○"), "pk")), fmt("FAIL tests/s%d.py\n", "o")),
    "go": lambda i: wrapped(listed(i, ["o"], ["ln", "pk"], fmt("--- %s: t_%d (0.00s)", _outcome("PASS", "FAIL", "SKIP"), "pk")), "", fmt("\nok  \ttests/s%d.py\t0.1s", "o")),
}
RESULTS = f"(SELECT o, 'tests/s' || o || '.py' AS suite, 't_' || pk AS name, {OUTCOME} AS outcome FROM {ITEMS} i)"


def _results(kind: str):
    def run(spark, sf):
        return parsed(RESULT_TEXTS[kind](items(spark, sf)), ["o"], X.test_results(kind), X.RESULTS).select("o", "suite", "name", "outcome")

    register(f"results_{kind}", run, f"SELECT o, suite, name, outcome FROM {RESULTS} r", f"Tests of {kind} output with their suite and outcome.")


for _kind in RESULT_TEXTS:
    _results(_kind)


@query(f"SELECT o, suite, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE outcome = 'failed'), '') AS failures FROM {RESULTS} r GROUP BY o, suite")
def results_summary(spark, sf):
    """Outcomes by suite and the tests that failed, whichever runner wrote the output."""
    i = items(spark, sf)
    text = None
    for n, make in enumerate(RESULT_TEXTS.values()):
        one = make(i.where(F.col("o") % len(RESULT_TEXTS) == n)).select("o", "text")
        text = one if text is None else text.unionByName(one)
    return analyses.suite_summary(parsed(text, ["o"], X.test_results("auto"), X.RESULTS), ["o"]).withColumn("failures", F.array_join("failures", ","))


def _skeleton(kind: str, head: str, case: str, level: int, name: str, n_lines: int, offset: int, first: str, tail: str = ""):
    """A file of twenty tests in one suite: ``case`` takes ``n_lines`` lines, its test stands at ``offset`` of them."""
    suites = f"SELECT f, 0::BIGINT AS level, 'suite' AS kind, {first} AS name, {len(head.splitlines())}::BIGINT AS line FROM (SELECT DISTINCT f FROM {PARTS} p) d UNION ALL " if first else ""
    sql = f"{suites}SELECT f, {level}::BIGINT, 'test', '{name}' || pk{' AS name' if not suites else ''}, {len(head.splitlines())} + {n_lines} * i + {offset} FROM {PARTS} q"
    if not suites:
        sql = f"SELECT f, {level}::BIGINT AS level, 'test' AS kind, '{name}' || pk AS name, {len(head.splitlines())} + {n_lines} * i + {offset} AS line FROM {PARTS} q"

    def run(spark, sf):
        text = wrapped(listed(parts(spark, sf), ["f"], ["pk"], fmt(case, "pk")), fmt(head + "\n", "f") if "%d" in head else head + "\n" if head else "", tail)
        return parsed(text, ["f"], X.test_skeleton(kind), X.TESTS).select("f", *big("level"), "kind", "name", *big("line"))

    register(f"tests_{kind}", run, sql, f"Tests that {kind} files define, with their nesting.")


_skeleton("jest", "describe('suite %d', () => {", "  it('t %d', () => {\n  });", 1, "t ", 2, 1, "'suite ' || f", "\n});")
_skeleton("pytest", "class TestF%d:", "    def test_%d(self):\n        pass\n", 1, "test_", 3, 1, "'TestF' || f")
_skeleton("rspec", "RSpec.describe 'suite %d' do", "  it 't %d' do\n  end", 1, "t ", 2, 1, "'suite ' || f", "\nend")
_skeleton("rust", "#[cfg(test)]\nmod f%d {", "    #[test]\n    fn t%d() {\n    }", 1, "t", 3, 2, "'f' || f", "\n}")
_skeleton("junit", "class F%dTest {", "    @Test\n    void t%d() {\n    }", 1, "t", 3, 2, "'F' || f || 'Test'", "\n}")
_skeleton("go", "package x", "func TestP%d(t *testing.T) {\n}", 0, "TestP", 2, 1, "")


# --- schemas and configurations


def _members(name: str, sql: str, text, parse, doc: str):
    def run(spark, sf):
        return parsed(text(parts(spark, sf)), ["f"], parse, X.MEMBERS).select("f", "type", "kind", "name", "detail")

    register(name, run, f"SELECT f, type, kind, name, detail FROM ({sql.replace('PARTS', PARTS)}) s", doc)


def _body(p: DataFrame, line: Column, head: Column, tail: str, sep: str = "\n") -> DataFrame:
    return wrapped(listed(p, ["f"], ["pk"], line, sep), head, tail)


_members("proto_members", "SELECT f, 'M' || f AS type, 'field' AS kind, 'p' || pk AS name, CASE WHEN pk % 2 = 0 THEN 'repeated string' ELSE 'int64' END AS detail FROM PARTS p UNION ALL SELECT DISTINCT f, 'S', 'rpc', 'Get', '(Q) → (M' || f || ')' FROM PARTS p UNION ALL SELECT DISTINCT f, 'E', 'value', 'NONE', '0' FROM PARTS p", lambda p: wrapped(listed(p, ["f"], ["pk"], fmt("  %s p%d = %d; // x", F.when(F.col("pk") % 2 == 0, "repeated string").otherwise("int64"), "pk", "size")), fmt("message M%d {\n", "f"), "").withColumn("text", F.concat("text", fmt("\n}\nservice S {\n  rpc Get (Q) returns (M%d);\n}\nenum E {\n  NONE = 0;\n}", "f"))), X.proto, "Fields, calls and values of protobuf files.")
_members("graphql_members", "SELECT f, 'T' || f AS type, 'field' AS kind, 'p' || pk AS name, CASE WHEN pk % 2 = 0 THEN '(x: Int)String!' ELSE '[Int]' END AS detail FROM PARTS p UNION ALL SELECT DISTINCT f, 'E', 'value', 'ONE', '' FROM PARTS p", lambda p: _body(p, F.when(F.col("pk") % 2 == 0, fmt("  p%d(x: Int): String! # note", "pk")).otherwise(fmt("  p%d: [Int],", "pk")), fmt("type T%d {\n", "f"), "\n}\nenum E {\n  ONE\n}"), X.graphql, "Fields and values of GraphQL schemas.")
_members("css_rules", "SELECT f, '.p' || pk AS type, 'rule' AS kind, '' AS name, CASE WHEN pk % 2 = 0 THEN '2' ELSE '1' END AS detail FROM PARTS p", lambda p: _body(p, F.when(F.col("pk") % 2 == 0, fmt(".p%d { color: red; margin: %d }", "pk", "size")).otherwise(fmt(".p%d {\n  margin: %d;\n}", "pk", "size")), F.lit("@import 'x';\n/* .no { a: b } */\n"), "\n@media print { .x { y: z } }"), X.css, "Rules of style sheets with their properties.")
_members("sql_schema", "SELECT f, 't' || f AS type, 'column' AS kind, 'c' || pk AS name, CASE WHEN pk % 2 = 0 THEN 'DECIMAL(1,2)' ELSE 'INT' END AS detail FROM PARTS p", lambda p: _body(p, F.when(F.col("pk") % 2 == 0, fmt("  c%d DECIMAL(1,2) NOT NULL", "pk")).otherwise(fmt("  c%d INT", "pk")), fmt("CREATE TABLE IF NOT EXISTS t%d (\n", "f"), ",\n  PRIMARY KEY (c1)\n);", ",\n"), X.db_schema, "Columns of SQL tables.")
_members("prisma_schema", "SELECT f, 'M' || f AS type, 'column' AS kind, 'c' || pk AS name, CASE WHEN pk % 2 = 0 THEN 'Int' ELSE 'String?' END AS detail FROM PARTS p", lambda p: _body(p, F.when(F.col("pk") % 2 == 0, fmt("  c%d Int @id // x", "pk")).otherwise(fmt("  c%d String?", "pk")), fmt("model M%d {\n", "f"), "\n  @@index([c1])\n}"), X.db_schema, "Fields of Prisma models.")
_members("openapi_endpoints", "SELECT f, '/p' || pk AS type, 'get' AS kind, u.name, CASE u.name WHEN 'summary' THEN 'part ' || pk WHEN 'id' THEN 'id (query, required)' ELSE '200 ok' END AS detail FROM PARTS p, (VALUES ('summary'), ('id'), ('200')) u(name)", lambda p: _body(p, fmt("  /p%d:\n    get:\n      summary: part %d\n      parameters: [{name: id, in: query, required: true}]\n      responses:\n        200: {description: ok}", "pk", "pk"), F.lit("openapi: 3.0.0\npaths:\n"), ""), X.openapi, "Operations, parameters and responses of OpenAPI documents.")


@query(f"SELECT f, 'P' || pk AS key, CASE WHEN pk % 2 = 0 THEN size::VARCHAR END AS value, pk % 2 = 1 AS required, CASE WHEN pk % 3 = 0 THEN 'part ' || pk END AS description FROM {PARTS} p")
def env_keys(spark, sf):
    """Keys of environment files, their defaults and what the comment above says; the first of a key counts."""
    line = F.concat(F.when(F.col("pk") % 3 == 0, fmt("# part %d\n", "pk")).otherwise(""), F.when(F.col("pk") % 2 == 0, fmt('export P%d="%d"\n', "pk", "size")).otherwise(fmt("P%d=\n", "pk")))
    text = listed(parts(spark, sf), ["f"], ["pk"], line).withColumn("text", F.concat("text", F.lit("\nnone\n"), "text"))
    return parsed(text, ["f"], X.env, X.ENV).select("f", "key", "value", "required", "description")


@query(f"SELECT f, i AS n, CASE WHEN pk % 2 = 0 THEN 'code' ELSE 'markdown' END AS kind, 'part ' || pk AS preview, 2::BIGINT AS lines, CASE WHEN pk % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS outputs, CASE WHEN pk % 2 = 0 THEN 'out ' || size || chr(10) || 'E1' || chr(10) || 'E2' END AS output FROM {PARTS} p")
def notebook_cells(spark, sf):
    """Cells of notebooks with their outputs."""
    cell = F.when(F.col("pk") % 2 == 0, fmt('{"cell_type":"code","source":["part %d\\n","x"],"outputs":[{"text":["out ","%d"]},{"traceback":["E1","E2"]}]}', "pk", "size")).otherwise(fmt('{"cell_type":"markdown","source":"part %d\\nx"}', "pk"))
    return parsed(wrapped(listed(parts(spark, sf), ["f"], ["pk"], cell, ","), '{"cells":[', "]}"), ["f"], X.notebook, X.CELLS).select("f", "n", "kind", "preview", *big("lines", "outputs"), "output")


@query(f"SELECT f, 1::BIGINT AS level, 'File ' || f AS title, 'file-' || f AS anchor, 1::BIGINT AS first, max(4 * i) + 7 AS last FROM {PARTS} p GROUP BY f UNION ALL SELECT f, 2, 'Part ' || pk, 'part-' || pk, 4 * i + 4, 4 * i + 7 FROM {PARTS} p")
def markdown_toc(spark, sf):
    """Headings of Markdown files, underlined and marked, with the lines of their sections."""
    text = wrapped(listed(parts(spark, sf), ["f"], ["pk"], fmt("## `Part` %d ##\n```\n# no\n```", "pk")), fmt("File %d\n===\n\n", "f"))
    return parsed(text, ["f"], X.markdown_headings, X.HEADINGS).select("f", *big("level"), "title", "anchor", *big("first", "last"))


@query(f"SELECT f, 'last' AS anchor, 'Last' AS title, '## Last' || chr(10) || 'of ' || f AS content FROM (SELECT DISTINCT f FROM {PARTS} p) d UNION ALL SELECT f, 'all', 'All', '## All' || chr(10) || string_agg('### P' || pk || chr(10) || 'size ' || size, chr(10) ORDER BY pk) FROM {PARTS} p GROUP BY f")
def markdown_sections(spark, sf):
    """Sections of Markdown files by anchor, in the order asked for; missing ones are passed over."""
    text = wrapped(listed(parts(spark, sf), ["f"], ["pk"], fmt("### P%d\nsize %d", "pk", "size")), "# Top\n## All\n").withColumn("text", F.concat("text", fmt("\n## Last\nof %d", "f")))
    return parsed(text, ["f"], X.sections(["last", "none", "all"]), X.SECTIONS).select("f", "anchor", "title", "content")


def _tree(spark, sf):
    return wrapped(listed(parts(spark, sf), ["f"], ["pk"], fmt('"p%d":{"size":%d,"tags":[{"x":null},2]}', "pk", "size"), ","), '{"parts":{', '},"ok":true}')


KEYS_SQL = f"""SELECT f, 'parts' AS key, 1::BIGINT AS depth, 'object' AS kind FROM (SELECT DISTINCT f FROM {PARTS} p) d UNION ALL SELECT f, 'ok', 1, 'boolean' FROM (SELECT DISTINCT f FROM {PARTS} p) d
UNION ALL SELECT f, 'parts.p' || pk || s.k, s.d, s.t FROM {PARTS} p, (VALUES ('', 2, 'object'), ('.size', 3, 'number'), ('.tags', 3, 'array'), ('.tags[0].x', 5, 'null')) s(k, d, t)"""


@query(KEYS_SQL)
def json_keys(spark, sf):
    """Keys of JSON documents to a depth of five, of arrays those of the first element."""
    return parsed(_tree(spark, sf), ["f"], X.tree_keys(5), X.KEYS).select("f", "key", *big("depth"), "kind")


@query(KEYS_SQL)
def yaml_keys(spark, sf):
    """The same of YAML documents."""
    return parsed(_tree(spark, sf), ["f"], X.tree_keys(5, "yaml"), X.KEYS).select("f", "key", *big("depth"), "kind")


@query(f"SELECT f, 'p' || pk AS key, 1::BIGINT AS depth, 'object' AS kind FROM {PARTS} p UNION ALL SELECT f, 'p' || pk || '.size', 2, 'number' FROM {PARTS} p")
def toml_keys(spark, sf):
    """Keys of TOML documents."""
    return parsed(listed(parts(spark, sf), ["f"], ["pk"], fmt("[p%d]\nsize = %d", "pk", "size")), ["f"], X.tree_keys(2, "toml"), X.KEYS).select("f", "key", *big("depth"), "kind")


@query(f"SELECT f, 'array' AS kind, '[' || string_agg(size::VARCHAR, ', ' ORDER BY pk) || ']' AS value FROM {PARTS} p GROUP BY f")
def json_value(spark, sf):
    """The value at a path of each JSON document."""
    text = wrapped(listed(parts(spark, sf), ["f"], ["pk"], F.col("size").cast("string"), ","), '{"a":{"b":[0,{"sizes":[', "]}]}}")
    return parsed(text, ["f"], X.values("a.b[1].sizes"), X.VALUE).select("f", "kind", "value")


@query(f"SELECT f, i > 0 AS failed FROM (SELECT DISTINCT f, f % 2 AS i FROM {PARTS} p) d")
def json_value_errors(spark, sf):
    """Which documents have no value at a path, or cannot be read: errors, not failures of the job."""
    text = parts(spark, sf).select("f").distinct().withColumn("text", F.when(F.col("f") % 2 == 0, '{"a":[1]}').when(F.col("f") % 4 == 1, '{"a":[]}').otherwise("{broken"))
    return X.rows_of(text, ["f"], "text", X.values("a[0]"), X.VALUE).select("f", F.col("error").isNotNull().alias("failed"))


# --- code


#: Extension: a definition of four or three lines in that language, its kind, name and signature, its last line.
CODE = {
    "py": ("def part_%d(size):\n    return %d\n", "function", "part_", "def part_{}(size)", 3, 1),
    "rs": ("pub fn part_%d(x: u8) -> u8 {\n    %d\n}\n", "function", "part_", "pub fn part_{}(x: u8) -> u8", 4, 2),
    "go": ("func Part%d(x int) int {\n\treturn %d\n}\n", "function", "Part", "func Part{}(x int) int", 4, 2),
    "ts": ("export function part%d(x: number): number {\n  return %d;\n}\n", "function", "part", "export function part{}(x: number): number", 4, 2),
    "java": ("    public int part%d(int x) {\n        return %d;\n    }\n", "method", "part", "public int part{}(int x)", 4, 2),
    "cs": ("  public static int Part%d(\n    int x) { return %d; }\n", "method", "Part", "public static int Part{}( int x)", 3, 1),
    "kt": ("fun part%d(x: Int): Int {\n  return %d\n}\n", "function", "part", "fun part{}(x: Int): Int", 4, 2),
    "swift": ("func part%d(x: Int) -> Int {\n  return %d\n}\n", "function", "part", "func part{}(x: Int) -> Int", 4, 2),
    "php": ("function part%d($x) {\n  return %d;\n}\n", "function", "part", "function part{}($x)", 4, 2),
    "cpp": ("int part%d(int x) {\n  return %d;\n}\n", "function", "part", "int part{}(int x)", 4, 2),
    "rb": ("def part%d(x)\n  %d\nend\n", "function", "part", "def part{}(x)", 4, 2),
    "lua": ("function part%d(x)\n  return %d\nend\n", "function", "part", "function part{}(x)", 4, 2),
}


def sources(spark, sf, ext: str) -> DataFrame:
    return listed(parts(spark, sf), ["f"], ["pk"], fmt(CODE[ext][0], "pk", "size")).select("f", fmt(f"src/f%d.{ext}", "f").alias("path"), "text")


def _grammar(ext: str):
    _, kind, name, sig, n, end = CODE[ext]
    shown = "'" + sig.replace("'", "''").replace("{}", "' || pk || '") + "'"

    def run(spark, sf):
        return symbols.symbols_of(sources(spark, sf, ext)).select("path", "id", "name", "signature")

    register(f"symbols_{ext}", run, f"SELECT 'src/f' || f || '.{ext}' AS path, '{kind}:' || ({n} * i + 1) || '-' || ({n} * i + {end + 1}) AS id, '{name}' || pk AS name, {shown} AS signature FROM {PARTS} p", f"Definitions of .{ext} files: the skeleton.")


for _ext in CODE:
    _grammar(_ext)


@query(f"SELECT 'src/f' || f || '.py' AS path, 'function:' || (3 * i + 1) || '-' || (3 * i + 2) AS id, 'def part_' || pk || '(size):' || chr(10) || '    return ' || size AS body FROM {PARTS} p UNION ALL SELECT 'src/f' || f || '.py', x.id, x.e || x.id FROM (SELECT DISTINCT f FROM {PARTS} p) d, (VALUES ('function:1-999', 'Error: out of range '), ('part', 'Error: invalid id ')) x(id, e)")
def symbol_bodies(spark, sf):
    """Bodies by id; an id that is none, or outside the text, gives an error as its body."""
    files = sources(spark, sf, "py")
    asked = symbols.symbols_of(files).select("path", "id")
    odd = files.select("path", F.explode(F.array(F.lit("function:1-999"), F.lit("part"))).alias("id"))
    return symbols.bodies(files, asked.unionByName(odd))


def _long(spark, sf) -> DataFrame:
    """Files of twenty functions of ten plain lines each."""
    body = F.concat(fmt("pub fn part_%d(x: u8) -> u8 {\n", "pk"), F.repeat(fmt("    value of %d\n", "size"), 10), F.lit("}\n"))
    return listed(parts(spark, sf), ["f"], ["pk"], body).select(fmt("src/f%d.rs", "f").alias("path"), "text")


_HEAD = "'pub fn part_' || pk || '(x: u8) -> u8"


@query(f"SELECT 'src/f' || f || '.rs' AS path, 'function:' || (13 * i + 1) || '-' || (13 * i + 12) AS id, {_HEAD} {{' || chr(10) || '… 10 line(s) …' || chr(10) || '}}' AS shown FROM {PARTS} p")
def code_sketch(spark, sf):
    """Definitions with what is no structure left out."""
    files = _long(spark, sf)
    return symbols.zoomed(files, symbols.symbols_of(files), "sketch")


_SHOWN = f"SELECT {_HEAD}' AS skeleton, {_HEAD} {{' || chr(10) || '… 10 line(s) …' || chr(10) || '}}' AS sketch, {_HEAD} {{' || chr(10) || repeat('    value of ' || size || chr(10), 10) || '}}' AS body FROM {PARTS} p"


@query(" UNION ALL ".join(f"SELECT '{z}' AS zoom, sum({est(z)})::BIGINT AS tokens FROM ({_SHOWN}) s" for z in ("skeleton", "sketch", "body")))
def zoom_tokens(spark, sf):
    """Tokens of all definitions at each zoom."""
    files = _long(spark, sf)
    syms = symbols.symbols_of(files)
    out = None
    for z in ("skeleton", "sketch", "body"):
        one = symbols.zoomed(files, syms, z).agg(F.sum(T.est_tokens("shown")).alias("tokens")).select(F.lit(z).alias("zoom"), "tokens")
        out = one if out is None else out.unionByName(one)
    return out


def _program(spark, sf):
    """A Python file for twenty parts: each function calls the next part's, the last one a helper that no file defines."""
    from pyspark.sql import Window

    # spread before the window, or Spark joins its parts by their bytes and the window's distribution serves all that follows: one task writes and parses every file
    p = spread(parts(spark, sf), "f").withColumn("next", F.lead("pk").over(Window.partitionBy("f").orderBy("pk")))
    body = F.concat(fmt("def part_%d(size):\n    return ", "pk"), F.when(F.col("next").isNull(), "helper(size)").otherwise(fmt("part_%d(size)", "next")), F.lit(" if len(x) else y\n"))
    return listed(p, ["f"], ["pk"], body).select("f", fmt("src/f%d.py", "f").alias("path"), "text")


PROGRAM = f"(SELECT *, lead(pk) OVER (PARTITION BY f ORDER BY pk) AS next FROM {PARTS} p)"


def _functions(files):
    return symbols.symbols_of(files).where("kind = 'function'").select(F.col("path").alias("file"), "kind", "name", "signature", "start", "end")


def _file_lines(files):
    return lines.explode_lines(files.select(F.col("path").alias("file"), "text"), ["file"])


@query(f"SELECT 'src/f' || f || '.py' AS file, 'part_' || pk AS caller, x.callee, CASE WHEN x.callee = 'part_' || next THEN 'src/f' || f || '.py' END AS callee_file, 3 * i + 2 AS first_line, 1::BIGINT AS calls FROM (SELECT *, unnest(['len', coalesce('part_' || next, 'helper')]) AS callee FROM {PROGRAM} p) x")
def call_graph(spark, sf):
    """Who calls whom, and which file defines it."""
    files = _program(spark, sf)
    return relations.call_graph(_functions(files), relations.calls(_file_lines(files)))


@query(f"SELECT 'part_' || p.pk AS name, 'src/f' || p.f || '.py' AS file, 3 * p.i + 1 AS line, (b.pk IS NOT NULL)::BIGINT AS usages, (b.pk IS NOT NULL)::BIGINT AS callers, (b.pk IS NOT NULL)::BIGINT AS files, 0::BIGINT AS test_files, (b.pk IS NOT NULL)::BIGINT AS blast_radius FROM {PARTS} p LEFT JOIN {PROGRAM} b ON b.next = p.pk WHERE p.pk IN (20, 21, 47)")
def refactor_impact(spark, sf):
    """Where three names are defined, used and called, and how far a change of them reaches."""
    files = _program(spark, sf)
    return relations.refactor_impact(_functions(files), _file_lines(files), ["part_20", "part_21", "part_47"])


@query(f"SELECT 'src/f' || f || '.py' AS file, 'part_' || pk AS name, 'high' AS confidence FROM {PARTS} p WHERE i = 0")
def dead_code(spark, sf):
    """Functions that nothing refers to."""
    files = _program(spark, sf)
    return relations.dead_code(_functions(files), relations.mentions(_file_lines(files))).select("file", "name", "confidence")


@query(f"SELECT 'src/f' || f || '.py' AS file, line_no, before, line, after FROM (SELECT *, 3 * i + 2 AS line_no, 'def part_' || pk || '(size):' AS before, '    return part_' || next || '(size) if len(x) else y' AS line, '' AS after FROM {PROGRAM} p) x WHERE next % 100 = 7")
def symbol_usages(spark, sf):
    """Uses of names with a line on either side."""
    found = lines.matches_in_context(_program(spark, sf).withColumnRenamed("path", "file"), ["file"], r"return part_(\d*0)?7\(", 1)
    around = F.split(F.array_join("context", "\n"), "\n")
    bare = lambda i: F.regexp_replace(F.get(around, i), r"^\d+: ", "")
    return found.select("file", "line_no", bare(0).alias("before"), "line", F.coalesce(bare(1), F.lit("")).alias("after"))


@query(f"SELECT 'part_' || pk AS name, 'function' AS kind, 3 * i + 1 AS line, 'public' AS visibility FROM {PARTS} p")
def api_surface(spark, sf):
    """Public names."""
    return parsed(sources(spark, sf, "py"), ["f"], X.api_surface("py"), X.API).select("name", "kind", *big("line"), "visibility")


@query(f"SELECT f, CASE WHEN pk % 2 = 0 THEN 'import {{ a, b as c }} from \"../m' || pk || '\"' ELSE 'import \"lib' || pk || '\"' END AS raw, CASE WHEN pk % 2 = 0 THEN '../m' || pk ELSE 'lib' || pk END AS target, CASE WHEN pk % 2 = 0 THEN 'm' || pk || '.ts' END AS resolved, CASE WHEN pk % 2 = 0 THEN 'a,b' ELSE '' END AS symbols FROM {PARTS} p")
def code_deps(spark, sf):
    """Imports with the file they point to and the names they bring in."""
    text = listed(parts(spark, sf), ["f"], ["pk"], F.when(F.col("pk") % 2 == 0, fmt('import { a, b as c } from "../m%d"', "pk")).otherwise(fmt('import "lib%d"', "pk"))).withColumn("path", fmt("src/f%d.ts", "f"))
    return X.rows_by_path(text, ["f"], "path", "text", X.code_deps, X.DEPS).select("f", "raw", "target", "resolved", "symbols")


@query(f"SELECT 'm' || pk AS stem, 'src/f' || f || '.ts' AS file FROM {PARTS} p WHERE pk % 2 = 0")
def imported_by(spark, sf):
    """Which files import a target."""
    text = listed(parts(spark, sf), ["f"], ["pk"], F.when(F.col("pk") % 2 == 0, fmt('import { a } from "../m%d"', "pk")).otherwise(fmt("const m = m%d;", "pk"))).select(fmt("src/f%d.ts", "f").alias("path"), "text")
    return relations.imported_by(_file_lines(text), parts(spark, sf).select(fmt("m%d", "pk").alias("stem")))


@query(f"SELECT f, 'I' || pk AS type, 'interface' AS kind, 'size' AS name, 'number' AS detail, 3 * i + 2 AS line FROM {PARTS} p")
def type_skeleton(spark, sf):
    """Types and their members."""
    text = listed(parts(spark, sf), ["f"], ["pk"], fmt("export interface I%d {\n  size: number; // %d\n}", "pk", "size"))
    return parsed(text, ["f"], X.type_skeleton("ts"), X.FIELDS).select("f", "type", "kind", "name", "detail", *big("line"))


@query(f"SELECT f, 'P' || pk AS type, 'interface' AS kind, 2 * i + 1 AS line FROM {PARTS} p WHERE pk % 2 = 0")
def interface_conformance(spark, sf):
    """Types that implement an interface."""
    text = listed(parts(spark, sf), ["f"], ["pk"], fmt("class P%d implements %s {\n}", "pk", F.when(F.col("pk") % 2 == 0, "Sized").otherwise("Other")))
    return parsed(text, ["f"], X.conforms_to("Sized", "ts"), X.CONFORMS).select("f", "type", "kind", *big("line"))


@query(f"SELECT 'a' || f || '.md' AS path, 'h2' AS kind, 'P' || pk AS name, i + 1 AS line FROM {PARTS} p WHERE f % 3 = 0 UNION ALL SELECT 'a' || f || '.py', 'function', 'part_' || pk, 3 * i + 1 FROM {PARTS} p WHERE f % 3 = 1 UNION ALL SELECT DISTINCT 'a' || f || '.bin', 'unknown', NULL, NULL FROM {PARTS} p WHERE f % 3 = 2")
def file_outline(spark, sf):
    """The outline of each file by its extension; a file that cannot be read by any is unknown."""
    third = F.col("f") % 3
    text = listed(parts(spark, sf), ["f"], ["pk"], F.when(third == 0, fmt("## P%d", "pk")).when(third == 1, fmt(CODE["py"][0], "pk", "size")).otherwise(fmt("%d", "pk")))
    path = F.concat(fmt("a%d", "f"), F.when(third == 0, ".md").when(third == 1, ".py").otherwise(".bin"))
    return X.rows_by_path(text.withColumn("path", path), ["path"], "path", "text", X.outline, X.OUTLINE).select("path", "kind", "name", *big("line"))


TRACES = {
    "py": ('  File "src/p%d.py", line %d, in go', ".py", "'go'"), "js": ("    at go (src/p%d.js:%d:5)", ".js", "'go'"), "java": ("\tat x.Y.go(P%d.java:%d)", ".java", "'x.Y.go'"),
    "rs": ("             at src/p%d.rs:%d:9", ".rs", "NULL"), "go": ("\tsrc/p%d.go:%d +0x1", ".go", "NULL"),
}
_FRAME = " ".join(f"WHEN {i} THEN {fn}" for i, (_, _, fn) in enumerate(TRACES.values()))
_FILE = " ".join(f"WHEN {i} THEN {repr('P' if n == 'java' else 'src/p')} || pk || '{e}'" for i, (n, (_, e, _)) in enumerate(TRACES.items()))


def _traces(spark, sf):
    line = F.lit(None).cast("string")
    for i, (shape, _, _) in enumerate(TRACES.values()):
        line = F.when(F.col("pk") % 5 == i, fmt(shape, "pk", "size")).otherwise(line)
    text = wrapped(listed(parts(spark, sf), ["f"], ["pk"], line), "Error: x\n").withColumn("text", F.concat("text", F.lit("\n"), "text"))
    return parsed(text, ["f"], X.stack_frames, X.FRAMES).select("f", "n", "file", *big("line"), "function")


@query(f"SELECT f, i AS n, CASE pk % 5 {_FILE} END AS file, size AS line, CASE pk % 5 {_FRAME} END AS function FROM {PARTS} p")
def stack_frames(spark, sf):
    """Frames of stack traces in five languages, each place once."""
    return _traces(spark, sf)


@query(f"""WITH fr AS (SELECT f, i AS n, CASE pk % 5 {_FILE} END AS file, size AS line FROM {PARTS} p), src AS (SELECT file, g.l AS line_no FROM (SELECT DISTINCT file, pk FROM (SELECT CASE pk % 5 {_FILE} END AS file, pk FROM {PARTS} p) a WHERE pk % 2 = 0) b, unnest(generate_series(1, 30)) g(l))
SELECT f, n, fr.file, line, string_agg(CASE WHEN line_no = line THEN '> ' ELSE '  ' END || line_no || ': line ' || line_no, chr(10) ORDER BY line_no) AS source FROM fr LEFT JOIN src ON fr.file = src.file AND line_no BETWEEN line - 2 AND line + 2 GROUP BY f, n, fr.file, line""")
def stack_trace_source(spark, sf):
    """Frames with the lines around them; files without source give none."""
    frames = written(_traces(spark, sf))
    half = frames.select("file").distinct().where(F.regexp_extract("file", r"(\d+)\.", 1).cast("bigint") % 2 == 0)
    source = half.select("file", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("line_no")).withColumn("line", F.concat(F.lit("line "), F.col("line_no").cast("string")))
    return analyses.frames_with_source(frames, source, ["f"], 2)
