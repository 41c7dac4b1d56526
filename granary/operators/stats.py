"""Composition of a corpus: token maps, statistics, trees, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with tokens, chars, n_lines and size_bytes."""
    return df.select(*[c for c in df.columns if c not in (text, "tokens", "chars", "n_lines", "size_bytes")], T.est_tokens(text).alias("tokens"), F.length(text).cast("bigint").alias("chars"), T.n_lines(text).alias("n_lines"), F.octet_length(text).cast("bigint").alias("size_bytes"))


def workspace_stats(rows: DataFrame, group: str = "lang") -> DataFrame:
    """Per group: files, lines, tokens and the share of all tokens. The total is a window over the few groups."""
    by = rows.groupBy(group).agg(F.count("*").alias("files"), F.sum("n_lines").alias("lines"), F.sum("tokens").alias("tokens"))
    return by.withColumn("pct", T.pct1(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))


def largest(rows: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), F.col(tie)).limit(n)


def token_map(rows: DataFrame, key: str, keep: Column, n: int = 50) -> DataFrame:
    """The n rows of most tokens among those kept, with totals over all kept ones."""
    kept = rows.where(keep)
    total = kept.agg(F.sum("tokens").alias("total_tokens"), F.count("*").alias("total_files"))
    return largest(kept.select(key, "tokens", "size_bytes"), "tokens", key, n).crossJoin(F.broadcast(total))  # one row of totals


# Fixed value: tokens saved for a token used, in hundredths.
SAVED = 669


def dashboard(calls: DataFrame) -> DataFrame:
    """Calls (tool, success, duration_ms, token_count) by tool: calls, errors, mean duration (whole), tokens used and saved; the busiest first."""
    by = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.floor(F.sum("duration_ms") / F.count("*")).cast("bigint").alias("avg_ms"), F.sum("token_count").cast("bigint").alias("tokens"))
    return by.withColumn("tokens_saved", F.expr(f"tokens * {SAVED} div 100")).orderBy(F.col("calls").desc(), "tool")


def directory_tree(paths: DataFrame, path: str = "path", depth: int = 3) -> DataFrame:
    """(entry, depth, is_dir, files): every prefix of the paths up to a depth."""
    parts = paths.select(F.filter(F.split(path, "/"), lambda x: x != "").alias("parts")).where(F.size("parts") > 0)
    level = parts.select("parts", F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth)))).alias("depth"))
    one = level.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("entry"), "depth", (F.col("depth") < F.size("parts")).alias("inner"))
    return one.groupBy("entry", "depth").agg(F.max("inner").alias("is_dir"), F.count("*").alias("files"))


def rendered_tree(tree: DataFrame) -> DataFrame:
    """(entry, line): indented names, directories with a slash."""
    name = F.element_at(F.split("entry", "/"), -1)
    return tree.select("entry", F.concat(F.repeat(F.lit("  "), (F.col("depth") - 1).cast("int")), name, F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


def language_mix(paths: DataFrame, path: str = "path", manifests: dict[str, str] | None = None) -> DataFrame:
    """Files by language, ten more for each manifest of that language."""
    known = manifests or {"Cargo.toml": "rust", "package.json": "javascript", "pyproject.toml": "python", "go.mod": "go", "pom.xml": "java"}
    name = F.element_at(F.split(path, "/"), -1)
    bonus = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    plain = paths.select(T.language(F.col(path)).alias("language"), F.lit(1).alias("n"))
    extra = paths.select(F.try_element_at(bonus, name).alias("language"), F.lit(10).alias("n")).where("language is not null")
    return plain.unionByName(extra).groupBy("language").agg(F.sum("n").alias("score"))
