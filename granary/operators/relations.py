"""Joins between what documents define, mention and cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.session import spread, written


#: Lines of a block by which instrumented lines and symbols meet.
BLOCK = 64


def coverage(hit_lines: DataFrame, symbols: DataFrame, file: str = "file") -> DataFrame:
    """Lines (file, line_no, hit) within symbols (file, name, start, end), both ends included: covered, total and percent.

    Lines are counted by file and line, and the counts of BLOCK lines make one row; a symbol meets the rows
    of the blocks that it touches and counts its own lines in them: one equi-join on file and block, so
    neither a long file nor a long symbol meets line by line. Both sides stay spread, and the join is by
    merge: of many short files a task would else hold millions of rows, or a broadcast all of them. A line
    counts in every symbol around it. A symbol without instrumented lines is fully covered.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    lines = spread(hit_lines.select(F.col(file).alias("file"), block("line_no").alias("block"), "line_no", F.col("hit").cast("boolean").alias("hit")), "file", "block")
    counts = lines.groupBy("file", "block", "line_no").agg(F.count_if("hit").alias("covered"), F.count("*").alias("total"))
    blocks = counts.groupBy("file", "block").agg(F.collect_list(F.struct("line_no", "covered", "total")).alias("lines"))
    asked = spread(symbols.select(F.col(file).alias("file"), "name", "start", "end"), "file").distinct()
    touched = F.when(F.col("start") <= F.col("end"), F.sequence(block("start"), block("end"))).otherwise(F.array(F.lit(None).cast("bigint")))
    met = spread(asked.select("*", F.explode(touched).alias("block")), "file", "block").join(blocks.hint("merge"), ["file", "block"], "left")
    within = F.filter("lines", lambda x: x["line_no"].between(F.col("start"), F.col("end")))
    sums = lambda c: F.coalesce(F.aggregate(within, F.lit(0).cast("bigint"), lambda s, x: s + x[c]), F.lit(0)).alias(c)
    parts = met.select("file", "name", "start", "end", sums("covered"), sums("total"))
    out = parts.groupBy("file", "name", "start", "end").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    return out.withColumn("pct", T.pct1(F.col("covered"), F.col("total"), empty=100.0)).withColumnRenamed("file", file)


def overall_coverage(hit_lines: DataFrame) -> DataFrame:
    """(covered, total, pct) of all instrumented lines in scope, whatever symbols are shown."""
    out = hit_lines.agg(F.count_if(F.col("hit")).alias("covered"), F.count("*").alias("total"))
    return out.withColumn("pct", T.pct1(F.col("covered"), F.col("total"), empty=100.0))


def unreferenced(symbols: DataFrame, mentions: DataFrame) -> DataFrame:
    """Symbols (file, name, start, end) that no mention (file, line_no, name) outside their own lines refers to.

    Mentions are first reduced to each name's least and greatest line in a file, which combines before the shuffle.
    """
    m = mentions.groupBy("name", "file").agg(F.min("line_no").alias("least"), F.max("line_no").alias("greatest")).alias("m")
    s = symbols.alias("s")
    outside = (F.col("m.file") != F.col("s.file")) | (F.col("m.least") < F.col("s.start")) | (F.col("m.greatest") > F.col("s.end"))
    return s.join(m, (F.col("s.name") == F.col("m.name")) & outside, "left_anti")


# Names that are never reported as dead.
EXEMPT = ("main", "new", "default", "init", "setup", "teardown", "drop", "fmt", "clone", "debug", "display", "from", "into", "deref", "deref_mut", "index", "index_mut", "add", "sub", "mul", "div", "eq", "partial_eq", "hash", "serialize", "deserialize")


def dead_code(symbols: DataFrame, mentions: DataFrame, include_exported: bool = False) -> DataFrame:
    """Unreferenced functions and types, by confidence: exported ones may be used from elsewhere."""
    kinds = ["function", "method", "class", "struct", "enum", "trait"]
    name = F.col("name")
    tests = name.startswith("test_") | name.startswith("Test") | name.endswith("_test") | name.endswith("Test")
    asked = symbols.where(F.col("kind").isin(kinds) & ~F.lower("name").isin(*EXEMPT) & ~tests & (F.octet_length("name") > 2)).withColumn("exported", T.is_exported(F.col("signature")))
    asked = asked if include_exported else asked.where("not exported")
    return unreferenced(asked, mentions).withColumn("confidence", F.when(F.col("exported"), "medium").otherwise("high"))


def mentions(lines: DataFrame) -> DataFrame:
    """(file, line_no, name): each identifier of each line once."""
    words = F.array_distinct(F.regexp_extract_all("line", F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0)))
    return lines.select("file", "line_no", F.explode_outer(words).alias("name")).where("name is not null")


def once_only(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """Terms that occur in exactly one document: the least and the greatest are the same, in one pass that combines before the shuffle."""
    return terms.groupBy(term).agg(F.min(doc).alias(doc), F.max(doc).alias("__most")).where(F.col(doc) == F.col("__most")).select(term, doc)


# Words before a parenthesis that are no calls.
NO_CALLS = ("if", "for", "while", "match", "switch", "return", "catch", "loop", "fn", "def", "func", "function", "class", "struct", "enum", "trait", "impl", "let", "const", "var", "new", "in", "and", "or", "not", "as", "elif", "else", "assert", "yield", "await", "async", "Some", "None", "Ok", "Err", "Vec", "String", "Box")


def calls(lines: DataFrame) -> DataFrame:
    """(file, line_no, callee): each name called in a line once; keywords, constructors and names in capitals are passed over."""
    found = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([a-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    return lines.select("file", "line_no", F.explode_outer(found).alias("callee")).where(F.col("callee").isNotNull() & ~F.col("callee").isin(*NO_CALLS))


def call_graph(symbols: DataFrame, called: DataFrame) -> DataFrame:
    """(file, caller, callee, callee_file, first_line, calls): calls within each function's lines, with the files that define the name.

    ``symbols`` (file, name, start, end) are functions; a call belongs to the innermost one around it: the
    last that starts at or before its line. A name's own calls of itself are left out. One hop; see
    ``reachable`` for more. Callees are the rows of a caller, callers those of a callee.
    """
    start = symbols.select("file", F.col("start").alias("line_no"), F.struct("name", F.col("end").alias("end")).alias("at"), F.lit(None).cast("string").alias("callee"), F.lit(0).alias("o"))
    rows = start.unionByName(called.select("file", "line_no", F.lit(None).cast(start.schema["at"].dataType).alias("at"), "callee", F.lit(1).alias("o")))
    w = Window.partitionBy("file").orderBy("line_no", "o").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("at", F.last("at", ignorenulls=True).over(w)).where("callee is not null and at is not null and line_no <= at.end and callee <> at.name")
    by = inside.groupBy("file", F.col("at.name").alias("caller"), "callee").agg(F.min("line_no").alias("first_line"), F.count("*").alias("calls"))
    defined = symbols.select(F.col("name").alias("callee"), F.col("file").alias("callee_file")).distinct()
    return by.join(defined, "callee", "left").select("file", "caller", "callee", "callee_file", "first_line", "calls")


def refactor_impact(symbols: DataFrame, lines: DataFrame, names: list[str]) -> DataFrame:
    """Per name: where it is defined (the first file and line), the functions around its uses, files and test files that use it, and how far a change reaches.

    Only lines that hold one of the names leave the scan.
    """
    from granary.sources.files import is_test_file

    asked = F.array(*[F.lit(n) for n in names])
    held = F.array_intersect(F.regexp_extract_all("line", F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0)), asked)
    used = lines.select("file", "line_no", F.explode(held).alias("name"))
    first = symbols.where(F.col("name").isin(names)).groupBy("name").agg(F.min(F.struct("file", F.col("start").alias("line"))).alias("at"))
    own = symbols.where(F.col("name").isin(names)).select("name", "file", F.col("start").alias("line_no"), F.lit(True).alias("own"))
    uses = used.join(own, ["name", "file", "line_no"], "left").where("own is null").drop("own")
    by = uses.groupBy("name").agg(F.count("*").alias("usages"), F.count_distinct("file").alias("files"), F.count_distinct(F.when(is_test_file(F.col("file")), F.col("file"))).alias("test_files"))
    around = call_graph(symbols, uses.select("file", "line_no", F.col("name").alias("callee"))).groupBy(F.col("callee").alias("name")).agg(F.count_distinct(F.struct("file", "caller")).alias("callers"))
    every = lines.sparkSession.createDataFrame([(n,) for n in names], "name string")
    out = every.join(first, "name", "left").join(by, "name", "left").join(around, "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("name", F.col("at.file").alias("file"), F.col("at.line").alias("line"), zero("usages"), zero("callers"), zero("files"), zero("test_files"), F.coalesce("files", F.lit(0)).alias("blast_radius"))


def imported_by(lines: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, file): files with an import line that holds the stem of a target as a word; ``stems`` (stem) may be many, they meet by word."""
    imports = lines.where(F.trim("line").rlike(r"^(import|from|use|pub use|export|#include|require|const .*require\()\b") | F.col("line").contains("require("))
    words = F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_-]+"), F.lit(0)))
    return imports.select("file", F.explode(words).alias("stem")).join(stems.select("stem").distinct(), "stem").select("stem", "file").distinct()


def call_edges(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls (file, line_no, callee) under the definition before them (file, line_no, name) in the same file: (caller, callee) edges.

    The backward as-of join is a window: the last definition at or before each call.
    """
    rows = calls.select("file", "line_no", "callee", F.lit(None).cast("string").alias("name"), F.lit(1).alias("o")).unionByName(definitions.select("file", "line_no", F.lit(None).cast("string").alias("callee"), "name", F.lit(0).alias("o")))
    w = Window.partitionBy("file").orderBy("line_no", "o").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("caller", F.last("name", ignorenulls=True).over(w)).where("callee is not null and caller is not null and caller <> callee").groupBy("file", "caller", "callee").agg(F.count("*").alias("calls"))


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within ``depth`` hops of the start nodes; each round is one join with the nodes found new, which are written: else a round holds the plans of all before it, twice."""
    seen = written(start.select("node", F.lit(0).alias("hops")))
    new = seen
    for hop in range(1, depth + 1):
        new = written(new.join(edges, F.col("node") == F.col("caller")).select(F.col("callee").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(new)
    return seen.groupBy("node").agg(F.min("hops").alias("hops"))


def schema_diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys added, removed or modified between two sides; null values compare as equal."""
    b = before.select(*key, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("was"))
    a = after.select(*key, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("is"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~same, "modified")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change is not null").drop("was", "is")


def line_set_diff(before: DataFrame, after: DataFrame, on: list[str], width: int = 80) -> DataFrame:
    """Lines that only one side has, as sets, cut to a width."""
    cut = F.substring("line", 1, width).alias("line")
    gone = before.select(*on, "line").distinct().join(after.select(*on, "line").distinct(), [*on, "line"], "left_anti").select(*on, F.lit("removed").alias("change"), cut)
    come = after.select(*on, "line").distinct().join(before.select(*on, "line").distinct(), [*on, "line"], "left_anti").select(*on, F.lit("added").alias("change"), cut)
    return gone.unionByName(come)
