"""Queries over symbols of files that hold whole documents, packs for a question, renames, and digests kept by version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import digests, history, lines, scored
from granary.plans.corpus import BRANCH_SQL, est, nlines
from granary.plans.registry import query, table
from granary.plans.reports import PARTS, fmt, listed, parts

_CLEAN = "translate(regexp_replace(text, '\r', '', 'g'), '\"\\', '')"


@query(
    rf"""WITH l AS (SELECT doc_id, len(parts) AS n, trim(unnest(parts)) AS s FROM (SELECT doc_id, string_split({_CLEAN}, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) t),
c AS (SELECT doc_id, n, 1 + sum(CASE WHEN regexp_matches(s, '^(//|#|\*|/\*)') THEN 0 ELSE {BRANCH_SQL} END)::BIGINT AS complexity FROM l GROUP BY doc_id, n),
f AS (SELECT doc_id, 'first' AS name, NULL AS owner, 1::BIGINT AS s, 3::BIGINT AS e, 2::BIGINT AS complexity FROM c UNION ALL SELECT doc_id, 'held', 'Doc', 6, n + 8, complexity FROM c)
SELECT doc_id, name, owner, s AS start, e AS "end", complexity, CASE WHEN complexity BETWEEN 1 AND 5 THEN 'low' WHEN complexity BETWEEN 6 AND 10 THEN 'medium' WHEN complexity BETWEEN 11 AND 20 THEN 'high' ELSE 'critical' END AS risk FROM f"""
)
def complexity_by_symbol(spark, sf):
    """Decision points of each function, where a method holds a whole document and another stands before it; a comment behind the last statement is outside."""
    docs = table(spark, sf, "documents").where("text is not null")
    clean = reduce(lambda text, c: F.replace(text, F.lit(c), F.lit("")), '\r"\\', F.col("text"))
    source = F.concat(F.lit('def first(x):\n    if x and not x: x = [y for y in x]\n    return x\n\nclass Doc:\n    def held(self):\n        return """\n'), clean, F.lit('\n"""\n        # if this for that\n'))
    out = scored.complexity_by_symbol(docs.select(F.format_string("d/%d.py", "doc_id").alias("path"), source.alias("text")))
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), "name", "owner", "start", "end", "complexity", "risk")


_ASKED = T.keywords("where is the invoice of the billing")


@query(
    f"""WITH p AS (SELECT *, CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN size % 7 = 0 THEN 1 ELSE 0 END AS b, 'src/f' || f || '.py' AS path FROM {PARTS} p),
best AS (SELECT path, sum(a) + sum(b) AS score FROM p GROUP BY path HAVING sum(a) + sum(b) > 0 ORDER BY score DESC, path LIMIT 8)
SELECT row_number() OVER (ORDER BY 13 * a + 3 * b DESC, score DESC, path, i) AS n, path, CASE a WHEN 1 THEN 'invoice_' ELSE 'part_' END || pk AS name, (13 * a + 3 * b)::BIGINT AS score,
'def ' || CASE a WHEN 1 THEN 'invoice_' ELSE 'part_' END || pk || '(' || CASE b WHEN 1 THEN 'billing' ELSE 'x' END || '):' || chr(10) || '    return ' || pk AS body FROM p JOIN best USING (path) WHERE a + b > 0"""
)
def symbol_pack(spark, sf):
    """Symbols of the files that hold most of a question's words, by their names and signatures, with their bodies."""
    name = F.when(F.col("size") % 5 == 0, "invoice").otherwise("part")
    arg = F.when(F.col("size") % 7 == 0, "billing").otherwise("x")
    text = listed(parts(spark, sf), ["f"], ["pk"], fmt("def %s_%d(%s):\n    return %d", name, "pk", arg, "pk"))
    return scored.context_pack(text.select(fmt("src/f%d.py", "f").alias("path"), "text"), _ASKED, 1 << 30).select("n", "path", "name", "score", "body")


@query(
    f"""SELECT f, 'src/p' || pk || '.rs' AS path, CASE WHEN pk % 3 < 2 THEN 'src/old' || pk || '.rs' END AS old_path, CASE WHEN pk % 3 < 2 THEN 'renamed' ELSE 'modified' END AS status,
CASE pk % 3 WHEN 0 THEN 100 WHEN 1 THEN 50 + size END AS similarity, CASE WHEN pk % 3 = 0 THEN 0 ELSE 1 END AS n_hunk, CASE WHEN pk % 3 = 0 THEN 0 ELSE 2 END AS n_added, CASE WHEN pk % 3 = 0 THEN 0 ELSE 1 END AS n_deleted FROM {PARTS} p"""
)
def renamed_files(spark, sf):
    """Files of diffs that were moved, moved and changed, or changed."""
    p = parts(spark, sf)
    moved = F.when(F.col("pk") % 3 == 0, F.lit("similarity index 100%\n")).when(F.col("pk") % 3 == 1, F.concat(F.lit("similarity index "), (F.col("size") + 50).cast("string"), F.lit("%\n")))
    names = fmt("rename from src/old%d.rs\nrename to src/p%d.rs", "pk", "pk")
    hunk = fmt("--- a/src/x\n+++ b/src/x\n@@ -1,2 +1,3 @@ fn part_%d() {\n-rename from here\n+%d\n+similarity index 3%%", "pk", "size")
    each = F.concat_ws("\n", fmt("diff --git a/src/p%d.rs b/src/p%d.rs", "pk", "pk"), F.concat(moved, names), F.when(F.col("pk") % 3 > 0, hunk))
    found = history.file_changes(history.parse_diff(lines.explode_lines(listed(p, ["f"], ["pk"], each), ["f"]).withColumnRenamed("f", "diff")))
    return found.withColumnRenamed("diff", "f")


_NOW = "(SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || chr(10) || 'more' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 AND lang IS NOT NULL)"


@query(
    f"""SELECT *, (SELECT count(*) FROM {_NOW} x WHERE doc_id % 7 = 0) AS measured FROM (
SELECT CASE doc_id % 2 WHEN 0 THEN 'python' ELSE 'rust' END AS lang, count(*) AS files, coalesce(sum({nlines('text')}), 0)::BIGINT AS lines, coalesce(sum({est('text')}), 0)::BIGINT AS tokens FROM {_NOW} d GROUP BY 1) s"""
)
def digest_by_version(spark, sf):
    """Sums of a digest whose files are read once; of a later version only what changed is measured, what is gone is subtracted."""
    docs = table(spark, sf, "documents").where("lang is not null")
    path = F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".rs")))
    first = docs.select("doc_id", path.alias("path"), "text")
    more = first.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\nmore"))).otherwise(F.col("text")))
    versions = lambda df: df.select("path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("version"))
    before = digests.refresh(None, versions(first), first)
    after = digests.refresh(before, versions(more), more)
    return after.sums.withColumn("measured", F.lit(after.measured).cast("bigint"))
