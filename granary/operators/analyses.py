"""Composite analyses: security surface, complexity, context packs, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.session import spread

# Category, severity, confidence, literal.
RULES = [
    ("injection", "high", "low", ".exec("),
    ("injection", "high", "medium", "shell_exec("),
    ("injection", "high", "low", "system("),
    ("injection", "high", "medium", "popen("),
    ("injection", "high", "low", "subprocess.call("),
    ("injection", "high", "low", "subprocess.Popen("),
    ("injection", "medium", "low", "Command::new("),
    ("injection", "high", "low", "child_process.exec("),
    ("injection", "high", "low", "child_process.spawn("),
    ("injection", "high", "medium", "Runtime.getRuntime().exec("),
    ("injection", "high", "high", 'format!("SELECT'),
    ("injection", "high", "high", 'format!("INSERT'),
    ("injection", "high", "high", 'format!("UPDATE'),
    ("injection", "high", "high", 'format!("DELETE'),
    ("injection", "high", "high", 'f"SELECT'),
    ("injection", "high", "high", 'f"INSERT'),
    ("injection", "high", "medium", '" + req.'),
    ("injection", "high", "medium", '" + params.'),
    ("injection", "medium", "medium", "raw_query("),
    ("injection", "medium", "low", '.execute("'),
    ("xss", "high", "high", "innerHTML ="),
    ("xss", "high", "high", "innerHTML+="),
    ("xss", "high", "high", "dangerouslySetInnerHTML"),
    ("xss", "high", "high", "document.write("),
    ("xss", "high", "medium", "eval("),
    ("xss", "medium", "high", "outerHTML ="),
    ("xss", "medium", "medium", "insertAdjacentHTML("),
    ("xss", "high", "high", "__html:"),
    ("secrets", "critical", "high", 'password = "'),
    ("secrets", "critical", "high", 'password="'),
    ("secrets", "critical", "high", 'api_key = "'),
    ("secrets", "critical", "high", 'api_key="'),
    ("secrets", "critical", "high", 'secret = "'),
    ("secrets", "critical", "high", 'secret="'),
    ("secrets", "critical", "high", 'token = "'),
    ("secrets", "high", "high", 'private_key = "'),
    ("secrets", "high", "high", "-----BEGIN "),
    ("secrets", "high", "low", "aws_secret"),
    ("unsafe", "medium", "medium", "unsafe {"),
    ("unsafe", "medium", "medium", "unsafe fn "),
    ("unsafe", "high", "low", "from_raw("),
    ("unsafe", "high", "medium", "transmute("),
    ("unsafe", "high", "low", "ctypes."),
    ("unsafe", "medium", "medium", '@SuppressWarnings("unchecked")'),
    ("path_traversal", "high", "low", "../"),
    ("path_traversal", "medium", "high", "Path::new(req."),
    ("path_traversal", "medium", "high", "open(request."),
    ("path_traversal", "medium", "low", "File::open("),
    ("path_traversal", "medium", "low", "os.path.join("),
]
#: Literals that count inside quoted strings too.
CONTENT_RULES = ("../", "-----BEGIN ", "aws_secret")


def rules() -> list[tuple[str, str, str, str]]:
    return RULES


def outside_quotes(line: Column, literal: str) -> Column:
    """Whether a literal starts somewhere outside quoted strings: what lies before it closes every quote that it opens."""
    import re

    bare = r"(?:[^\"'\\]|\\.|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+')*?"
    return line.rlike("^" + bare + _bounded(literal, re.escape(literal)))


def _bounded(literal: str, pattern: str) -> str:
    return (r"(?<![A-Za-z0-9_])" if literal[0].isalnum() or literal[0] == "_" else "") + pattern


def security_surface(df: DataFrame, key: list[str], categories: list[str] | None = None, min_confidence: str = "low", ignore_line: str = "ignore-security", ignore_file: str = "ignore-security-scan", text: str = "text") -> DataFrame:
    """(key…, line_no, category, severity, confidence, pattern, description, snippet): lines of each text that hold a rule's literal.

    The rules are unrolled to one array expression over the lines that pass one cheap filter on all
    literals; comment lines, lines and texts with a marker, and what follows a test module's mark are
    left out. All happens within the row: only lines that may be findings are exploded, nothing is shuffled.
    """
    import re

    from granary.operators.lines import numbered

    asked = [r for r in rules() if (not categories or r[0] in categories) and T.RANKS["confidence"][r[2]] >= T.RANKS["confidence"][min_confidence]]
    literals = "|".join(re.escape(r[3]) for r in asked)
    some = df.where(F.col(text).rlike(literals)).withColumn("__lines", numbered(text))
    some = some.where(~F.exists(F.slice("__lines", 1, 20), lambda x: F.contains(x["line"], F.lit(ignore_file))))
    tests = F.array_min(F.transform(F.filter("__lines", lambda x: F.contains(x["line"], F.lit("#[cfg(test)]"))), lambda x: x["line_no"]))
    some = some.withColumn("__test", F.coalesce(tests, F.lit(1 << 60)))

    def open_line(x: Column) -> Column:
        line = x["line"]
        return (x["line_no"] < F.col("__test")) & line.rlike(literals) & ~F.contains(line, F.lit(ignore_line)) & ~F.trim(line).rlike(r"^(//|#|\*|/\*)")

    hits = some.select(*key, F.explode(F.filter("__lines", open_line)).alias("hit")).select(*key, "hit.line_no", "hit.line")

    def found(rule):
        category, severity, confidence, literal = rule
        hit = F.col("line").rlike(_bounded(literal, re.escape(literal))) if literal in CONTENT_RULES else outside_quotes(F.col("line"), literal)
        hit = F.col("line").contains(literal) & hit
        about = f"{category.replace('_', ' ')}: {literal.strip()}"
        return F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(literal).alias("pattern"), F.lit(about).alias("description")))

    rows = hits.select(*key, "line_no", F.substring(F.trim("line"), 1, 120).alias("snippet"), F.explode_outer(F.array(*[found(r) for r in asked])).alias("r")).where("r is not null")
    return rows.select(*key, "line_no", "r.*", "snippet")


def ranked_findings(found: DataFrame, key: list[str], limit: int = 100) -> DataFrame:
    """The findings that matter most: confidence, then severity, falling."""
    return found.orderBy(T.rank("confidence", F.col("confidence")).desc(), T.rank("severity", F.col("severity")).desc(), *key, "line_no", "pattern").limit(limit)


def rollup(found: DataFrame) -> DataFrame:
    """(by, value, n): findings by category, by severity and by confidence, in one pass."""
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("category", "severity", "confidence")]))).groupBy("by", "value").agg(F.count("*").alias("n"))


def complexity_map(lines: DataFrame, key: list[str], least: int = 1) -> DataFrame:
    """(key…, complexity, risk): one and the decision points of all lines, by keyword."""
    by = lines.groupBy(*key).agg((F.sum(T.complexity_of_line(F.col("line"))) + 1).alias("complexity"))
    return by.where(F.col("complexity") >= least).withColumn("risk", T.risk_label(F.col("complexity")))


def file_scores(files: DataFrame, path: Column, text: Column, words: list[str], n: int) -> DataFrame:
    """The n files that hold most keywords: five a word in the path, one for each of up to twenty in the text."""
    score = 5 * T.score_text(F.lower(path), words, 1) + T.score_text(F.lower(text), words, 20)
    return files.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), path).limit(n)


def budget_fill(pieces: DataFrame, query: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Pieces in order while they fit: one that does not is left out and the next is tried; (query…, taken, used, omitted).

    ``pieces`` are all candidates of a query, such as the matching lines of a few documents; the fold runs over the
    sorted array of their ``order`` and ``cost``, without their text.
    """
    sort = F.array_sort(F.collect_list(F.struct(*order, F.col(cost).cast("bigint").alias("cost"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("omitted"), F.array().cast(pieces.select(F.collect_list(F.struct(*order))).schema[0].dataType).alias("taken"))
    one = lambda x: F.array(F.struct(*[x[c].alias(c) for c in order]))
    fits = lambda s, x: s["used"] + x["cost"] <= budget
    fold = F.aggregate(sort, start, lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits(s, x), s["omitted"]).otherwise(s["omitted"] + 1).alias("omitted"), F.when(fits(s, x), F.concat(s["taken"], one(x))).otherwise(s["taken"]).alias("taken")))
    return pieces.groupBy(*query).agg(fold.alias("f")).select(*query, "f.taken", "f.used", "f.omitted")


def top_cosine(vectors: DataFrame, id: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k vectors nearest to one query by cosine, exactly: one pass and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.transform(vector, lambda x: x.cast("double"))
    return vectors.select(id, (dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))).alias("cosine")).orderBy(F.col("cosine").desc(), id).limit(k)


def audit_rank(findings: DataFrame, limit: int = 100, min_severity: str | None = None) -> DataFrame:
    """Findings from a severity on, each once, the worst first."""
    kept = findings if min_severity is None else findings.where(T.rank("audit", F.col("severity")) >= T.RANKS["audit"][min_severity])
    return kept.distinct().orderBy(T.rank("audit", F.col("severity")).desc(), "package", "id").limit(limit)


def diagnostics_rank(found: DataFrame, limit: int = 100, min_severity: str = "hint") -> DataFrame:
    """Diagnostics (file, line, col, severity, code, message) from a severity on, each once: the worst first, then by file, line, column and message."""
    kept = found.where(T.rank("diagnostics", F.col("severity")) >= T.RANKS["diagnostics"][min_severity]).distinct()
    return kept.orderBy(T.rank("diagnostics", F.col("severity")).desc(), "file", "line", "col", "message", "code").limit(limit)


def diagnostics_summary(found: DataFrame, limit: int = 100, min_severity: str = "hint") -> DataFrame:
    """(errors, warnings, hints, total, shown): counted over all, and how many a report of ``limit`` shows."""
    kept = found.where(T.rank("diagnostics", F.col("severity")) >= T.RANKS["diagnostics"][min_severity]).distinct()
    each = [F.count_if(F.col("severity") == x).alias(f"{x}s") for x in ("error", "warning", "hint")]
    return kept.agg(*each, F.count("*").alias("total")).withColumn("shown", F.least("total", F.lit(limit)))


def suite_summary(results: DataFrame, key: list[str], failed: int = 50) -> DataFrame:
    """Test results (key…, suite, name, outcome) by suite: passed, failed, skipped, and the first names of those that failed."""
    by = results.groupBy(*key, "suite").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("passed", "failed", "skipped")], F.array_sort(F.collect_set(F.when(F.col("outcome") == "failed", F.col("name")))).alias("names"))
    return by.withColumn("failures", F.slice("names", 1, failed)).drop("names")


def frames_with_source(frames: DataFrame, lines: DataFrame, key: list[str], context: int = 5) -> DataFrame:
    """Frames (key…, n, file, line) with the source around them: (key…, n, file, line, source), a > before the frame's own line.

    Each frame, named by key and n, asks for its lines by number, so it meets only those. The join is by merge: what a file's
    lines come to is not seen in the bytes that they are made from, so a broadcast of them may be more than a driver holds.
    """
    around = F.filter(F.sequence(F.col("line") - context, F.col("line") + context), lambda x: x > 0)
    asked = frames.select(*key, "n", "file", "line", F.explode_outer(around).alias("line_no"))
    body = lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.col("line").alias("body"))
    got = spread(asked, "file", "line_no").join(spread(body, "file", "line_no").hint("merge"), ["file", "line_no"], "left")
    shown = F.concat(F.when(F.col("line_no") == F.col("line"), "> ").otherwise("  "), F.col("line_no").cast("string"), F.lit(": "), F.col("body"))
    by = got.groupBy(*key, "n", "file", "line").agg(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("line_no", shown.alias("shown"))))).alias("s"))
    return by.select(*key, "n", "file", "line", F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["shown"]), "\n")).alias("source"))


def batch_read(reads: dict[str, DataFrame]) -> DataFrame:
    """(item, n, content, error) of several reads at once: each a table with a column ``content`` (and ``error`` where it can fail); one that cannot be planned is its error."""
    out = None
    for name, df in reads.items():
        if isinstance(df, Exception):
            continue
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        n = F.col("n").cast("bigint") if "n" in df.columns else F.lit(0).cast("bigint")
        one = df.select(F.lit(name).alias("item"), n.alias("n"), F.col("content").cast("string").alias("content"), error.alias("error"))
        out = one if out is None else out.unionByName(one)
    failed = [(name, 0, None, f"{type(e).__name__}: {e}") for name, e in reads.items() if isinstance(e, Exception)]
    if failed:
        spark = SparkSession.getActiveSession()
        rows = spark.createDataFrame(failed, "item string, n bigint, content string, error string")
        out = rows if out is None else out.unionByName(rows)
    return out


def symbols_catalogue(spark: SparkSession, queries: dict) -> DataFrame:
    """The registered queries and the first line of their description."""
    return spark.createDataFrame([(n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(queries.items())], "name string, about string")
