"""Line-oriented operators: explode, context, carried state, islands, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def explode_lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key…, line_no from 1, line): one row a line."""
    return df.select(*key, F.posexplode(T.lines(text)).alias("at", "line")).select(*key, (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def numbered(text: str) -> Column:
    """The lines of a text as an array of (line_no from 1, line)."""
    return F.transform(T.lines(text), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line")))


def matches_in_context(df: DataFrame, key: list[str], pattern: str, context: int = 2, text: str = "text") -> DataFrame:
    """(key…, line_no, line, context): lines of each text that match, with up to ``context`` lines on either side as "n: text", itself left out.

    All happens within the row: texts without a match are passed over, only matches are exploded, nothing is shuffled.
    """
    some = df.where(F.col(text).rlike(r"(?m)" + pattern)).withColumn("__lines", numbered(text))
    hits = some.select(*key, "__lines", F.explode(F.filter("__lines", lambda x: x["line"].rlike(pattern))).alias("hit"))
    n = F.col("hit.line_no").cast("int")
    around = F.filter(F.slice("__lines", F.greatest(n - context, F.lit(1)), F.lit(context) + F.least(n, F.lit(context + 1))), lambda x: x["line_no"] != F.col("hit.line_no"))
    shown = F.transform(around, lambda x: F.concat(x["line_no"].cast("string"), F.lit(": "), x["line"]))
    return hits.select(*key, F.col("hit.line_no").alias("line_no"), F.col("hit.line").alias("line"), shown.alias("context"))


def carry_forward(df: DataFrame, key: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """The last value that is not null up to each row: the current suite, file, function or author."""
    return df.withColumn(to, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of rows with the same value: (key…, island, value, first, last, rows), first and last by the first order column."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    marked = df.withColumn("island", F.sum(fresh.cast("bigint")).over(w))
    return marked.groupBy(*key, "island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"))


def adjacent_distinct(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__same", F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).where(~F.col("__same")).drop("__same")


def tail(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key, by descending order columns."""
    w = Window.partitionBy(*key).orderBy(*order) if key else Window.orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def log_tail(lines: DataFrame, key: list[str], n: int = 100, level: str | None = None, pattern: str | None = None) -> DataFrame:
    """Of the last 10·n lines those of a level and pattern, and of these the last n."""
    last = F.col("line_no").desc()
    out = tail(lines, key, [last], 10 * n).withColumn("level", T.log_level("line"))
    if level:
        out = out.where(F.col("level") == level.upper())
    if pattern:
        out = out.where(F.col("line").rlike(pattern))
    return tail(out, key, [last], n)


def level_counts(lines: DataFrame, key: list[str]) -> DataFrame:
    level = T.log_level("line")
    return lines.groupBy(*key).agg(*[F.count_if(level == x).alias(x.lower()) for x in ("ERROR", "WARN", "INFO", "DEBUG", "OTHER")])


# What makes a line part of a body's outline.
STRUCTURAL = r"^[\s{}()\[\];,]+$|[{:]\s*$|=>|^\s*end\b|^\s*(pub|fn|def|class|struct|enum|trait|impl|interface|type|return|if|else|for|while|match|switch|case|try|catch|finally|async|await|let|const|var|import|export|use|raise|throw|yield|break|continue)\b|\w+\s*\("


def sketch(lines: DataFrame, key: list[str]) -> DataFrame:
    """A body's outline: structural lines stay (the first always, comment lines never), runs of others become one "… N line(s) …"."""
    order = Window.partitionBy(*key).orderBy("line_no")
    comment = F.trim("line").rlike(r"^(//|#|\*|/\*|--)")
    keep = (F.row_number().over(order) == 1) | (F.col("line").rlike(STRUCTURAL) & ~comment)
    marked = lines.withColumn("__keep", keep)
    fresh = F.col("__keep") | ~F.coalesce(~F.lag("__keep").over(order), F.lit(False))
    grouped = marked.withColumn("__run", F.sum(fresh.cast("bigint")).over(order)).groupBy(*key, "__run", "__keep").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.min_by("line", "line_no").alias("line"))
    return grouped.select(*key, "line_no", F.when(F.col("__keep"), F.col("line")).otherwise(F.concat(F.lit("… "), F.col("n").cast("string"), F.lit(" line(s) …"))).alias("line"))
