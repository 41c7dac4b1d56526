"""Results of a batch factored to templates, for batches of any size.

The rule is the one of ``delta.factor``: in order of id, a result whose lines agree to a ratio with an earlier
template, and whose diff to it is shorter than itself, refers to the first such template; the others are templates.
There a batch is one row; here it is rows that meet by their lines:

* A ratio of t asks for t·(n + m) / 2 lines in common, so two results that reach it share one of the n - ⌈n·t / (2 - t)⌉ + 1
  rarest lines of each (the k-th occurrence of a line is a line of its own). Only those prefixes are joined, and pairs
  whose lengths exclude the ratio are dropped; the texts decide. Bands of hashed minima would miss pairs; this loses none.
* Rounds take the first undecided results of each batch, as many as four times the templates of the round before. These are
  compared with each other and decided in order (one is a template once no undecided one before it agrees with it);
  then all later ones are compared with the new templates, and what agrees is done. A batch of near-copies so takes one
  round of n comparisons, not n², and the first template that a result meets is the first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.delta import line_ratio, unified
from granary.session import spread, written


def prefixes(results: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys…, i, n, line): the hashes of each result's rarest lines, of which two that agree share one; lines of one result only are left out."""
    lines = results.select(*keys, "i", F.explode(F.split("t", "\r?\n", -1)).alias("line")).groupBy(*keys, "i", F.xxhash64("line").alias("line")).agg(F.count("*").alias("c"))
    each = lines.select(*keys, "i", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k"), "line").select(*keys, "i", F.xxhash64("line", "k").alias("line"))
    held = each.groupBy(*keys, "line").agg(F.count("*").alias("held"))
    ranked = each.join(held, [*keys, "line"]).groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("held", "line"))).alias("lines"))
    n = F.size("lines")
    taken = F.slice("lines", F.lit(1), (n - F.ceil(n * F.lit(least / (2 - least)) - F.lit(1e-9)) + 1).cast("int"))
    return ranked.select(*keys, "i", n.alias("n"), F.explode(taken).alias("x")).where("x.held > 1").select(*keys, "i", "n", F.col("x.line").alias("line"))


def _agreeing(pairs: DataFrame, results: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys…, i, j, ratio, diff) of the pairs whose texts agree and whose diff is worth it; pairs stay spread, as a few bytes of them take long to compare."""
    former = spread(pairs, *keys, "i").join(results.select(*keys, "i", F.col("t").alias("a")), [*keys, "i"])
    both = spread(former, *keys, "j").join(results.select(*keys, F.col("i").alias("j"), F.col("t").alias("b")), [*keys, "j"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ratios, diffs = [], []
            for a, b in zip(p["a"], p["b"], strict=True):
                r = line_ratio(a.replace("\r\n", "\n").split("\n"), b.replace("\r\n", "\n").split("\n"))
                d = unified(a, b) if r >= least else None
                ratios.append(r)
                diffs.append(d if d is not None and len(d) < len(b) else None)
            yield p.drop(columns=["a", "b"]).assign(ratio=ratios, diff=diffs).dropna(subset=["diff"])

    kinds = dict(both.dtypes)
    listed = [*keys, "i", "j"]
    return both.select(*listed, "a", "b").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in listed) + ", ratio double, diff string")


def _pairs(of: DataFrame, to: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys…, i, j): results ``to`` that share a line of their prefixes with ``of``, where the lengths allow the ratio."""
    met = of.select(*keys, "line", "i", F.col("n").alias("n_i")).join(to.select(*keys, "line", F.col("i").alias("j"), "n"), [*keys, "line"])
    return met.where((F.col("i") < F.col("j")) & (2 * F.least("n", "n_i") >= least * (F.col("n") + F.col("n_i")))).select(*keys, "i", "j").distinct()


def _in_order(chosen: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The templates (keys…, i) among the chosen ones, given all agreeing pairs of them: those that no template before them agrees with."""
    edges = edges.select(*keys, "i", "j")
    of = edges.withColumnRenamed("j", "later")
    open_, templates = chosen.select(*keys, "i"), None
    while True:
        blocked = edges.join(open_, [*keys, "i"], "left_semi").select(*keys, F.col("j").alias("i"))
        fresh = written(open_.join(blocked, [*keys, "i"], "left_anti"))
        templates = fresh if templates is None else templates.unionByName(fresh)
        covered = of.join(fresh, [*keys, "i"], "left_semi").select(*keys, F.col("later").alias("i"))
        open_ = written(open_.join(fresh, [*keys, "i"], "left_anti").join(covered, [*keys, "i"], "left_anti"))
        if open_.isEmpty():
            return templates


def factor(df: DataFrame, batch: list[str], id: str, text: str, least: float = 0.5) -> DataFrame:
    """(batch…, id, template_ref, ratio, diff) of results (batch…, id, text), ids being unique in a batch and batches not null.

    A null text counts as empty; an empty one is never referred to a template, as no diff is shorter. An empty table gives no rows.
    """
    keys = [f"b{n}" for n in range(len(batch))]
    results = written(df.select(*[F.col(b).alias(k) for b, k in zip(batch, keys, strict=True)], F.col(id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    prefix = written(prefixes(results, keys, least))
    left, most, found = results.select(*keys, "i"), 1, None
    first = Window.partitionBy(*keys).orderBy("i")
    while not left.isEmpty():
        chosen = written(left.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select(*keys, "i"))
        mine = prefix.join(chosen, [*keys, "i"], "left_semi")
        edges = written(_agreeing(_pairs(mine, mine, keys, least), results, keys, least))
        templates = written(_in_order(chosen, edges, keys))
        later = left.join(chosen, [*keys, "i"], "left_anti")
        theirs = prefix.join(later, [*keys, "i"], "left_semi")
        met = _agreeing(_pairs(prefix.join(templates, [*keys, "i"], "left_semi"), theirs, keys, least), results, keys, least)
        done = written(edges.join(templates, [*keys, "i"], "left_semi").unionByName(met).groupBy(*keys, F.col("j").alias("i")).agg(F.min(F.struct(F.col("i").alias("ref"), "ratio", "diff")).alias("at")))
        found = done if found is None else found.unionByName(done)
        left = written(later.join(done, [*keys, "i"], "left_anti"))
        batches = templates.select(*keys).distinct().count()
        most = max(2, 4 * -(-templates.count() // max(1, batches)))
    if found is None:
        found = results.select(*keys, "i", F.lit(None).cast(f"struct<ref:{dict(results.dtypes)['i']},ratio:double,diff:string>").alias("at")).limit(0)
    out = results.select(*keys, "i").join(found, [*keys, "i"], "left")
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, batch, strict=True)], F.col("i").alias(id), F.col("at.ref").alias("template_ref"), "at.ratio", "at.diff")
