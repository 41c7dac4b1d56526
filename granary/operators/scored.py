"""Figures of symbols from their lines: sums by blocks, complexity, and the symbols and bodies that fit a question's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import analyses, lines, symbols
from granary.operators.relations import BLOCK
from granary.session import spread, written


def sums_within(values: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (path, start, end, …) with ``total``: the sum of ``values`` (path, line_no, value) over its lines, both ends included.

    The values of BLOCK lines of a file make one row; a symbol meets the rows of the blocks that it touches, takes
    the sum of those within it and picks its lines of those at its ends: one equi-join on file and block, in which each side
    is read once. Rows with the same span go through it as one. A line counts in every symbol around it.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    span = ["path", "start", "end"]
    lines = values.select("path", block("line_no").alias("block"), "line_no", "value")
    blocks = spread(lines, "path", "block").groupBy("path", "block").agg(F.sum("value").alias("sum"), F.collect_list(F.struct("line_no", "value")).alias("lines"))
    held = [c for c in asked.columns if c not in span]
    spans = spread(asked, *span).groupBy(*span).agg(F.collect_list(F.struct(*held) if held else F.struct(F.lit(1))).alias("held"))
    touched = F.when(F.col("start") <= F.col("end"), F.sequence(block("start"), block("end"))).otherwise(F.array(F.lit(None).cast("bigint")))
    met = spread(spans.select("*", F.explode_outer(touched).alias("block")), "path", "block").join(blocks.hint("merge"), ["path", "block"], "left")
    within = (F.col("block") > block("start")) & (F.col("block") < block("end"))
    picked = F.aggregate(F.filter("lines", lambda x: x["line_no"].between(F.col("start"), F.col("end"))), F.lit(0).cast("bigint"), lambda s, x: s + x["value"])
    total = met.select(*span, "held", F.when(within, F.col("sum")).otherwise(picked).alias("part")).groupBy(*span).agg(F.first("held").alias("held"), F.coalesce(F.sum("part"), F.lit(0)).cast("bigint").alias("total"))
    rows = total.select(*span, "total", F.explode("held").alias("x"))
    return rows.select(*[F.col(c) if c in span else F.col("x")[c].alias(c) for c in asked.columns], "total")


def complexity_by_symbol(files: DataFrame, least: int = 1) -> DataFrame:
    """(path, name, owner, start, end, complexity, risk) of each function and method: one and the decision points of its lines.

    Lines leave their text before they are shuffled, and those that can have no decision point before they are counted. Null and empty texts have no functions.
    """
    found = symbols.symbols_of(files).where(F.col("kind").isin("function", "method")).select("path", "name", "owner", "start", "end")
    some = lines.explode_lines(files, ["path"]).where(T.may_branch(F.col("line")))  # a filter on the value would count twice
    values = some.select("path", "line_no", T.complexity_of_line(F.col("line")).alias("value"))
    out = sums_within(values, found).select("path", "name", "owner", "start", "end", (F.col("total") + 1).alias("complexity"))
    return out.where(F.col("complexity") >= least).withColumn("risk", T.risk_label(F.col("complexity")))


def complexity_totals(scored: DataFrame) -> DataFrame:
    """(analyzed, high_risk) over all functions of ``complexity_by_symbol``."""
    return scored.agg(F.count("*").alias("analyzed"), F.count_if(F.col("risk").isin("high", "critical")).alias("high_risk"))


def symbol_score(words: list[str]) -> Column:
    """Ten a keyword in a symbol's name, three for each of up to three in its signature."""
    return 10 * T.score_text(F.lower("name"), words, 1) + 3 * T.score_text(F.lower("signature"), words, 3)


def context_pack(files: DataFrame, words: list[str], budget: int, most_files: int = 8) -> DataFrame:
    """(n, path, id, kind, name, signature, score, body, used, omitted): the symbols of the ``most_files`` best files that hold a keyword, best first.

    Files and signatures always count against the budget; bodies are then filled in order while they fit,
    one that does not has a null body and the next is tried. ``used`` and ``omitted`` are those of the whole pack.
    Equal scores go by file (its score falling, then its path), then by line. Only the best files' texts are read into
    symbols, and the fold sees the costs of their symbols, not the bodies.
    """
    best = written(analyses.file_scores(files.select("path", "text"), F.col("path"), F.col("text"), words, most_files))
    found = symbols.symbols_of(best).withColumn("points", symbol_score(words)).where("points > 0")
    by = Window.orderBy(F.desc("points"), F.desc("score"), "path", "start", "id")  # the symbols of a few files
    scored = found.join(F.broadcast(best.select("path", "score")), "path").withColumn("n", F.row_number().over(by).cast("bigint"))  # most_files rows
    scored = scored.select("n", "path", "id", "kind", "name", "signature", F.col("points").alias("score"))
    bodies = symbols.bodies(best, scored.select("path", "id"))
    rows = written(scored.join(bodies, ["path", "id"]).select("n", "path", "id", "kind", "name", "signature", "score", "body"))
    listed = lambda df, order, *names: T.est_tokens(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*names).alias("row")))), lambda x: x["row"])))
    head = best.agg(listed(best, [(-F.col("score")).alias("a"), "path"], "path", "score").alias("files")).crossJoin(rows.agg(listed(rows, ["n"], "path", "id", "kind", "name", "signature", "score").alias("symbols")))  # a row each
    costs = rows.agg(F.array_sort(F.collect_list(F.struct("n", T.est_tokens("body").cast("bigint").alias("cost")))).alias("costs")).crossJoin(head)
    start = F.struct((F.col("files") + F.col("symbols")).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("omitted"), F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, s["omitted"]).otherwise(s["omitted"] + 1).alias("omitted"), F.when(fits, F.concat(s["taken"], F.array(x["n"]))).otherwise(s["taken"]).alias("taken"))

    filled = costs.select(F.aggregate("costs", start, step).alias("f"))
    shown = F.when(F.array_contains("f.taken", F.col("n")), F.col("body"))
    return rows.crossJoin(F.broadcast(filled)).select("n", "path", "id", "kind", "name", "signature", "score", shown.alias("body"), "f.used", "f.omitted")  # one row
