"""Queries over documents, pages and conversations, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import analyses, delta, lines, relations, rewrite, stats
from granary.plans.registry import ORACLE_SQL, query, table
from granary.sources import web

# SQL of the cost unit and of lines, for the queries below.
EST = r"greatest(1, (length(t) - length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))) // 4 + (length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) - length(regexp_replace(t, '[\x00-\x7F\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]', '', 'g'))) + length(regexp_replace(t, '[\x00-\x7F\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]', '', 'g')) // 2)::BIGINT"
NLINES = r"(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR suffix(t, chr(10)) THEN 0 ELSE 1 END)::BIGINT"
LINES = r"(SELECT doc_id, i::BIGINT AS line_no, regexp_replace(parts[i], '\r$', '') AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS parts FROM documents WHERE text <> '') s, unnest(generate_series(1, len(parts))) AS g(i))"


def est(column: str) -> str:
    return EST.replace("(t", f"({column}").replace("(t,", f"({column},")


def nlines(column: str) -> str:
    return NLINES.replace("(t)", f"({column})").replace("(t,", f"({column},").replace(" t =", f" {column} =")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.explode_lines(table(spark, sf, "documents"), ["doc_id"])


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return stats.measured(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))


MEASURED = f"(SELECT doc_id, lang, source, {est('text')} AS tokens, {nlines('text')} AS n_lines, octet_length(encode(text))::BIGINT AS size_bytes, length(text)::BIGINT AS chars FROM documents)"
PCT = "floor(tokens::DOUBLE / (sum(tokens) OVER ())::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"


@query(f"SELECT lang, files, lines, tokens, {PCT} AS pct FROM (SELECT lang, count(*) AS files, sum(n_lines)::BIGINT AS lines, sum(tokens)::BIGINT AS tokens FROM {MEASURED} m GROUP BY lang)")
def workspace_stats(spark, sf):
    """Files, lines, tokens and the share of tokens by language."""
    return stats.workspace_stats(_measured(spark, sf))


@query(f"SELECT doc_id, lang, tokens FROM {MEASURED} m ORDER BY tokens DESC, doc_id LIMIT 10")
def largest_files(spark, sf):
    """The ten documents of most tokens."""
    return stats.largest(_measured(spark, sf), "tokens", "doc_id", 10).select("doc_id", "lang", "tokens")


@query(f"SELECT doc_id, tokens, size_bytes, t.total_tokens, t.total_files FROM {MEASURED} m, (SELECT sum(tokens)::BIGINT AS total_tokens, count(*) AS total_files FROM {MEASURED} k WHERE regexp_matches(source, '^src1.*$')) t WHERE regexp_matches(source, '^src1.*$') ORDER BY tokens DESC, doc_id LIMIT 50")
def token_map(spark, sf):
    """The fifty costliest documents of sources src1*, with totals."""
    return stats.token_map(_measured(spark, sf), "doc_id", F.col("source").rlike(T.glob_name("src1*")), 50)


@query(f"SELECT doc_id, {est('text')} AS tokens, length(text)::BIGINT AS chars, {nlines('text')} AS n_lines FROM documents")
def count_tokens(spark, sf):
    """Tokens, code points and lines of each document."""
    return _measured(spark, sf).select("doc_id", "tokens", "chars", "n_lines")


@query(r"""WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages),
e AS (SELECT array_to_string(parts[1:d], '/') AS entry, d::INTEGER AS depth, d < len(parts) AS inside FROM p, unnest(generate_series(1, least(len(parts), 3))) AS g(d))
SELECT entry, depth, bool_or(inside) AS is_dir, count(*) AS files FROM e GROUP BY entry, depth""")
def directory_tree(spark, sf):
    """Prefixes of the pages' paths to a depth of three."""
    paths = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "").alias("path"))
    return stats.directory_tree(paths, depth=3)


@query(rf"""WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '<!--[^\n]*?-->', '', 'g'), '^\s+|\s+$', '', 'g') AS small FROM pages)
SELECT page_id, {est('html')} AS before_tokens, {est('small')} AS after_tokens, length(small)::BIGINT AS after_chars FROM c""")
def compress_text(spark, sf):
    """Pages without comments, trailing blanks and long gaps: tokens before and after."""
    small = table(spark, sf, "pages").select("page_id", T.est_tokens("html").alias("before_tokens"), T.compress_text("html").alias("small"))
    return small.select("page_id", "before_tokens", T.est_tokens("small").alias("after_tokens"), F.length("small").cast("bigint").alias("after_chars"))


TALK = "(SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"


def _talks(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


@query(rf"""WITH c AS (SELECT conv_id, text, substr(text, 1, 200) AS head FROM {TALK} s), d AS (SELECT *, regexp_extract(head, '(?s)\A(.*[.!?。！？])', 1) AS cut FROM c)
SELECT conv_id, CASE WHEN length(text) <= 200 THEN text ELSE (CASE WHEN cut <> '' THEN cut ELSE head END) || '...' || chr(10) || chr(10) || '[Conversation truncated to fit token budget]' END AS summary FROM d""")
def summarize_conversation(spark, sf):
    """Conversations cut to fifty tokens at a sentence end."""
    return _talks(spark, sf).select("conv_id", T.summarize("text", 50).alias("summary"))


REDUCED = f"""SELECT 'compress_text' AS operator, sum(before_tokens)::BIGINT AS before_tokens, sum(after_tokens)::BIGINT AS after_tokens FROM ({ORACLE_SQL['compress_text']}) c
UNION ALL SELECT 'summarize_conversation', sum({est('s.text')})::BIGINT, sum({est('t.summary')})::BIGINT FROM {TALK} s JOIN ({ORACLE_SQL['summarize_conversation']}) t USING (conv_id)"""


@query(f"SELECT operator, before_tokens, after_tokens, floor((before_tokens - after_tokens)::DOUBLE / before_tokens::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS saved_pct FROM ({REDUCED}) r")
def token_reduction(spark, sf):
    """Tokens that compressing pages and summarizing conversations save."""
    pages = compress_text(spark, sf).select(F.lit("compress_text").alias("operator"), "before_tokens", "after_tokens")
    talks = _talks(spark, sf).select(F.lit("summarize_conversation").alias("operator"), T.est_tokens("text").alias("before_tokens"), T.est_tokens(T.summarize("text", 50)).alias("after_tokens"))
    by = pages.unionByName(talks).groupBy("operator").agg(F.sum("before_tokens").alias("before_tokens"), F.sum("after_tokens").alias("after_tokens"))
    return by.withColumn("saved_pct", T.pct1(F.col("before_tokens") - F.col("after_tokens"), F.col("before_tokens")))


BUDGET = f"(SELECT conv_id, turn, used, CASE WHEN share < 50 THEN 'normal' WHEN share < 75 THEN 'conservative' WHEN share < 90 THEN 'aggressive' ELSE 'critical' END AS strategy FROM (SELECT conv_id, turn, used, used::DOUBLE / 400.0::DOUBLE * 100.0::DOUBLE AS share FROM (SELECT conv_id, turn, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS used FROM (SELECT conv_id, turn, {est('text')} AS tokens FROM conversations) a) b) c)"


def _budget(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.est_tokens("text").alias("tokens"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    used = turns.select("conv_id", "turn", F.sum("tokens").over(upto).alias("used"))
    return used.withColumn("strategy", T.budget_strategy(F.col("used"), F.lit(400)))


@query(f"SELECT conv_id, turn, used, strategy FROM {BUDGET} b")
def check_budget(spark, sf):
    """Tokens used up to each turn against a budget of 400, and the strategy."""
    return _budget(spark, sf)


@query(f"SELECT conv_id, turn, CASE strategy WHEN 'critical' THEN 'skeleton' WHEN 'aggressive' THEN 'sketch' ELSE 'body' END AS zoom FROM {BUDGET} b")
def zoom_level(spark, sf):
    """How closely each turn would be read."""
    return _budget(spark, sf).select("conv_id", "turn", T.zoom_level(F.col("strategy")).alias("zoom"))


@query(rf"""WITH l AS {LINES}, w AS (SELECT doc_id, line_no, line, array_to_string(list_concat(coalesce(list(line_no || ': ' || line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), coalesce(list(line_no || ': ' || line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), [])), chr(10)) AS context FROM l)
SELECT doc_id, line_no, line, context FROM w WHERE regexp_matches(line, '[0-9]{{3}}-[0-9]{{4}}')""")
def search_context(spark, sf):
    """Lines with a telephone number and two lines on either side."""
    found = lines.matches_in_context(table(spark, sf, "documents"), ["doc_id"], "[0-9]{3}-[0-9]{4}", 2)
    return found.withColumn("context", F.array_join("context", "\n"))



@query(rf"""WITH l AS {LINES} SELECT doc_id, line_no, line AS before, regexp_replace(line, '\btoken\b', 'credential', 'g') AS after, len(regexp_extract_all(line, '\btoken\b'))::BIGINT AS n FROM l WHERE regexp_matches(line, '\btoken\b')""")
def rename_preview(spark, sf):
    """What renaming a word would change, line by line."""
    return rewrite.rename(doc_lines(spark, sf), ["doc_id"], "token", "credential")


@query(rf"""WITH l AS {LINES}, b AS (SELECT doc_id, line_no, ((line_no - 1) // 5) AS block, regexp_matches(line, '[0-9]') AS hit FROM l),
s AS (SELECT doc_id, block, min(line_no) AS start, max(line_no) AS "end" FROM b GROUP BY doc_id, block)
SELECT s.doc_id, s.start, s."end", (count(*) FILTER (WHERE b.hit))::BIGINT AS covered, count(*) AS total, floor(((count(*) FILTER (WHERE b.hit))::DOUBLE / count(*)::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS pct
FROM s JOIN b ON s.doc_id = b.doc_id AND b.line_no BETWEEN s.start AND s."end" GROUP BY s.doc_id, s.start, s."end" """)
def coverage_range_join(spark, sf):
    """Lines with digits within blocks of five lines: covered, total, percent."""
    hit = doc_lines(spark, sf).select("doc_id", "line_no", F.col("line").rlike("[0-9]").alias("hit"))
    block = F.floor((F.col("line_no") - 1) / 5).alias("block")
    symbols = hit.groupBy("doc_id", block).agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).select("doc_id", F.col("block").cast("string").alias("name"), "start", "end")
    return relations.coverage(hit, symbols, "doc_id").drop("name")


WORDS = r"(SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}]+'))) AS term FROM documents)"


def _terms(spark, sf):
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", F.explode_outer(found).alias("term")).where("term is not null")


@query(f"SELECT term, min(doc_id) AS doc_id FROM {WORDS} w GROUP BY term HAVING count(DISTINCT doc_id) = 1")
def dead_terms(spark, sf):
    """Words of one document only."""
    return relations.once_only(_terms(spark, sf), "doc_id", "term")





@query(rf"""WITH l AS {LINES}, a AS (SELECT DISTINCT d.lang, line FROM l JOIN documents d USING (doc_id) WHERE d.source = 'src0'), b AS (SELECT DISTINCT d.lang, line FROM l JOIN documents d USING (doc_id) WHERE d.source = 'src1')
SELECT lang, 'removed' AS change, substr(line, 1, 80) AS line FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT lang, 'added' AS change, substr(line, 1, 80) AS line FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def line_set_diff(spark, sf):
    """Lines that one of two sources has and the other has not, by language."""
    docs = lines.explode_lines(table(spark, sf, "documents"), ["lang", "source"])
    return relations.line_set_diff(docs.where("source = 'src0'"), docs.where("source = 'src1'"), ["lang"])


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'fresh' ELSE 'already_sent' END AS state FROM documents")
def content_dedup(spark, sf):
    """Exact copies refer to the first of them."""
    return delta.content_dedup(table(spark, sf, "documents"), "doc_id", "text")


@query("""SELECT conv_id, role, turn, CASE WHEN before IS NULL THEN 'full' WHEN before = sha256(text) THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT *, lag(sha256(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations) s""")
def read_ledger(spark, sf):
    """Each turn against the one before of the same role."""
    return delta.read_ledger(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn"], "text").select("conv_id", "role", "turn", "state")


PAGE_H = r"""(SELECT page_id, (i - 1)::BIGINT AS n, tags[i] AS tag FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>') AS tags FROM pages) s, unnest(generate_series(1, len(tags))) AS g(i))"""


@query(rf"""SELECT page_id, n, regexp_extract(tag, '(?i)^<h([1-6])', 1)::BIGINT AS level, trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title,
replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(tag, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), '[^\p{{L}}\p{{N}} -]', '', 'g'), ' ', '-') AS anchor FROM {PAGE_H} h""")
def page_toc(spark, sf):
    """The headings of each page with their anchors."""
    return web.page_headings(table(spark, sf, "pages"), ["page_id"])


@query(None)
def html_to_markdown(spark, sf):
    """Pages as Markdown, with their tokens."""
    return web.html_to_markdown(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "markdown", T.est_tokens("markdown").alias("tokens"))



@query(r"""SELECT p_partkey AS id, upper(p_brand) AS title FROM part WHERE p_partkey % 4 = 0 AND NOT regexp_matches(upper(p_brand), '[^A-Z\s]') UNION ALL SELECT p_partkey, 'ALL PARTS' FROM part WHERE p_partkey % 4 = 1""")
def pdf_heading_rule(spark, sf):
    """Short lines in capitals, which converted documents use as headings."""
    key = F.col("p_partkey") % 4
    line = F.when(key == 0, F.upper("p_brand")).when(key == 1, "  ALL PARTS ").when(key == 2, F.repeat(F.lit("LONG "), 13)).otherwise("Not one")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), line.alias("line"))
    return rows.where(web.heading_rule(F.col("line"))).select("id", F.trim("line").alias("title"))


@query(rf"""WITH l AS {LINES}, f AS (SELECT doc_id, line_no, line, unnest(['token = "', '../', 'system(', 'eval(', 'secret = "']) AS pattern, unnest(['secrets', 'path_traversal', 'injection', 'xss', 'secrets']) AS category FROM l)
SELECT doc_id, line_no, category, pattern FROM f WHERE contains(line, pattern) AND NOT regexp_matches(trim(line), '^(//|#|\*|/\*)') AND pattern IN ('token = "', 'secret = "')
AND regexp_matches(line, CASE pattern WHEN 'token = "' THEN '^(?:[^"''\\]|\\.|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*'')*?\btoken = "' ELSE '^(?:[^"''\\]|\\.|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*'')*?\bsecret = "' END)""")
def security_scan(spark, sf):
    """Lines that set a token or secret in clear text."""
    found = analyses.security_surface(table(spark, sf, "documents"), ["doc_id"], categories=["secrets"], min_confidence="high")
    return found.where(F.col("pattern").isin('token = "', 'secret = "')).select("doc_id", "line_no", "category", "pattern")



BRANCH_SQL = " + ".join("(length(s) - length(replace(s, '{0}', ''))) // {1}".format(b.replace("'", "''"), len(b)) if "\t" not in b else f"(length(s) - length(replace(s, chr(9) || '{b[1:]}', ''))) // {len(b)}" for b in T.BRANCHES)


@query(rf"""WITH l AS {LINES}, c AS (SELECT doc_id, 1 + sum(CASE WHEN regexp_matches(s, '^(//|#|\*|/\*)') THEN 0 ELSE {BRANCH_SQL} END) AS complexity FROM (SELECT doc_id, trim(line) AS s FROM l) t GROUP BY doc_id)
SELECT doc_id, complexity::BIGINT AS complexity, CASE WHEN complexity BETWEEN 1 AND 5 THEN 'low' WHEN complexity BETWEEN 6 AND 10 THEN 'medium' WHEN complexity BETWEEN 11 AND 20 THEN 'high' ELSE 'critical' END AS risk FROM c""")
def complexity_map(spark, sf):
    """Decision points of each document by keyword, and the risk."""
    return analyses.complexity_map(doc_lines(spark, sf), ["doc_id"])


KW = T.keywords("which license and token or phone_number")
KW_SQL = " + ".join(f"least((length(x) - length(replace(x, '{k}', ''))) // {len(k)}, 20)" for k in KW)


@query(f"SELECT doc_id, score::BIGINT AS score FROM (SELECT doc_id, {KW_SQL} AS score FROM (SELECT doc_id, lower(text) AS x FROM documents) a) b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30")
def context_scores(spark, sf):
    """The thirty documents that hold most words of a question."""
    docs = table(spark, sf, "documents").select("doc_id", T.score_text(F.lower("text"), KW, 20).alias("score"))
    return docs.where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(30)




@query(r"""SELECT doc_id, substr(sha256(text), 1, 12) AS short_hash, CASE WHEN length(replace(text, chr(10), ' ')) > 160 THEN substr(replace(text, chr(10), ' '), 1, 157) || '...' ELSE replace(text, chr(10), ' ') END AS title FROM documents""")
def short_titles(spark, sf):
    """A short hash and title of each document."""
    return table(spark, sf, "documents").select("doc_id", T.short_hash("text").alias("short_hash"), T.truncate_title("text").alias("title"))


@query(rf"""WITH l AS {LINES}, c AS (SELECT CASE WHEN regexp_matches(line, '(?i)ERROR|CRITICAL|FATAL') THEN 'error' WHEN regexp_matches(line, '(?i)WARN') THEN 'warn' WHEN regexp_matches(line, '(?i)INFO') THEN 'info' WHEN regexp_matches(line, '(?i)DEBUG|TRACE') THEN 'debug' ELSE 'other' END AS level FROM l) SELECT level, count(*) AS n FROM c GROUP BY level""")
def line_levels(spark, sf):
    """Lines of all documents by log level."""
    return doc_lines(spark, sf).groupBy(F.lower(T.log_level("line")).alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) > 0 AS positive FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""")
def semantic_signs(spark, sf):
    """Which vectors point the way of the first one."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = vectors.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.crossJoin(F.broadcast(first)).select("vec_id", (dot > 0).alias("positive"))  # one query row

