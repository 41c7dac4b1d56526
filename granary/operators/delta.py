"""What changed since the last time: exact copies, read ledgers, run deltas, near-duplicate factoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_dedup(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, first_id, state): the first row of each content is fresh, later ones refer to it; null texts are one content. Only hashes are shuffled."""
    hashed = df.select(F.col(id).alias("id"), F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("id").alias("first_id"))
    return hashed.join(first, "h").select("id", "first_id", F.when(F.col("id") == F.col("first_id"), "fresh").otherwise("already_sent").alias("state"))


def content_ledger(df: DataFrame, key: list[str], order: str, text: str, mtime: str, run: str) -> DataFrame:
    """Each sending of a key against what was sent before: (key…, order, state).

    "already_sent" where the last one had the same content and mtime within this run, "cold" where it
    comes from an earlier run (a cold entry is never promoted), else "fresh".
    """
    w = Window.partitionBy(*key).orderBy(order)
    h = F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))
    rows = df.withColumn("now", F.struct(h.alias("h"), F.col(mtime).alias("m"))).withColumn("change", ~F.coalesce(F.col("now") == F.lag("now").over(w), F.lit(False)))
    # the run in which this stretch of equal content was recorded
    recorded = F.last(F.when(F.col("change"), F.col(run)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("change"), "fresh").when(F.col(run) == recorded, "already_sent").otherwise("cold")
    return rows.select(*key, order, state.alias("state"))


def delta_reset(ledger: DataFrame, key: str, pattern: str | None = None) -> DataFrame:
    """A ledger without the keys that hold the pattern; without a pattern nothing is left."""
    return ledger.where(~F.coalesce(F.contains(F.col(key), F.lit(pattern)), F.lit(False))) if pattern else ledger.where(F.lit(False))


def read_ledger(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """Each reading against the one before of the same key: full, unchanged or changed. A null text is a content like any other."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("h", F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")))
    before = F.lag("h").over(w)
    return rows.withColumn("state", F.when(F.row_number().over(w) == 1, "full").when(before == F.col("h"), "unchanged").otherwise("changed")).drop("h", text)


def cmd_report(runs: DataFrame, key: list[str], order: str, errors: str = "errors", warnings: str = "warnings") -> DataFrame:
    """Runs (key…, order, success, summary, errors, warnings) against the run before of the key; a first run gives no row.

    new_…, resolved and unchanged of both kinds; the summary only where success flipped, or where the
    run succeeded and its summary changed.
    """
    w = Window.partitionBy(*key).orderBy(order)
    was = lambda c: F.lag(c).over(w)
    rows = runs.withColumns({"_first": F.row_number().over(w) == 1, "_ok": was("success"), "_s": was("summary"), "_e": F.coalesce(was(errors), F.array().cast("array<string>")), "_w": F.coalesce(was(warnings), F.array().cast("array<string>"))}).where("not _first")
    flipped = F.col("success") != F.col("_ok")
    summary = F.when(flipped | (F.col("success") & ~F.col("summary").eqNullSafe(F.col("_s"))), F.col("summary"))
    parts = lambda now, before, name: [F.array_sort(F.array_except(now, before)).alias(f"new_{name}"), F.size(F.array_except(before, now)).cast("bigint").alias(f"resolved_{name}"), F.size(F.array_intersect(now, before)).cast("bigint").alias(f"unchanged_{name}")]
    return rows.select(*key, order, flipped.alias("success_changed"), summary.alias("summary"), *parts(errors, "_e", "errors"), *parts(warnings, "_w", "warnings"))


def run_delta(runs: DataFrame, key: list[str], order: str, messages: str = "messages") -> DataFrame:
    """Runs (key…, order, messages array) against the run before: messages new, resolved and unchanged."""
    w = Window.partitionBy(*key).orderBy(order)
    now, before = F.array_distinct(messages), F.array_distinct(F.coalesce(F.lag(messages).over(w), F.array().cast("array<string>")))
    return runs.select(*key, order, *[F.array_sort(x).alias(n) for n, x in (("new", F.array_except(now, before)), ("resolved", F.array_except(before, now)), ("unchanged", F.array_intersect(now, before)))])


def line_ratio(a: list[str], b: list[str]) -> float:
    """Twice the longest common subsequence of lines over the lines of both; a row of it is one whole number, whose bits are its steps."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    row = 0
    for x in a:
        y = row | places.get(x, 0)
        row = y & ~(y - (row << 1 | 1))
    return 2 * row.bit_count() / (len(a) + len(b))


def factorable_text(value: str | None) -> str | None:
    """The text by which a JSON result is factored: its content, section or value, of an array all of them joined; None where any element has no text."""
    import json

    try:
        tree = json.loads(value or "")
    except ValueError:
        return None
    parts = []
    for x in tree if isinstance(tree, list) else [tree]:
        text = x if isinstance(x, str) else next((x[k] for k in ("content", "section", "value") if isinstance(x.get(k), str)), None) if isinstance(x, dict) else None
        if text is None:
            return None
        parts.append(text)
    return "\n".join(parts) if parts else None


def factor(df: DataFrame, batch: list[str], id: str, text: str, least: float = 0.5) -> DataFrame:
    """Results of one batch factored to templates: (batch…, id, template_ref, ratio, diff).

    In order of id, a result whose lines agree to ``least`` with an earlier template, and whose diff to it
    is shorter than itself, refers to it; the others are templates. A batch is one request's handful of
    results, so it is one row; many batches go through Python together. Templates that cannot reach the ratio by their
    number of lines, or by the lines that they share at all, are passed over before any alignment.
    """
    import re
    from collections import Counter

    def one(ids: list, texts: list) -> list[dict]:
        templates: list[tuple] = []
        out = []
        for i, now in zip(ids, texts, strict=True):
            now = now or ""
            parts = re.split(r"\r?\n", now)
            bag = Counter(parts)
            ref, ratio, shown = None, None, None
            for tid, whole, tparts, tbag in templates:
                both = len(tparts) + len(parts)
                if 2 * min(len(tparts), len(parts)) < least * both or 2 * (bag & tbag).total() < least * both:
                    continue
                r = line_ratio(tparts, parts)
                if r >= least and len(d := unified(whole, now)) < len(now):
                    ref, ratio, shown = tid, r, d
                    break
            if ref is None:
                templates.append((i, now, parts, bag))
            out.append({"id": i, "template_ref": ref, "ratio": ratio, "diff": shown})
        return out

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in tables:
            yield p.drop(columns=["_ids", "_texts"]).assign(found=[one(list(i), list(t)) for i, t in zip(p["_ids"], p["_texts"], strict=True)])

    kinds = dict(df.dtypes)
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(id).alias("i"), F.col(text).alias("t"))))
    grouped = df.groupBy(*batch).agg(sorted_.alias("s")).select(*batch, F.transform("s", lambda x: x["i"]).alias("_ids"), F.transform("s", lambda x: x["t"]).alias("_texts"))
    found = grouped.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in batch) + f", found array<struct<id:{kinds[id]},template_ref:{kinds[id]},ratio:double,diff:string>>")
    return found.select(*batch, F.inline("found")).withColumnRenamed("id", id)


def unified(a: str, b: str, context: int = 2) -> str:
    import difflib

    return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=context))


def ledger_answer(before: str | None, now: str, most_bytes: int = 512 * 1024) -> tuple[str, str]:
    """("full" | "unchanged" | "diff", text): a diff only if it takes at most 60 % of the text's bytes."""
    if before is None or len(now.encode()) > most_bytes:
        return "full", now
    if before == now:
        return "unchanged", ""
    d = unified(before, now)
    return ("diff", d) if 10 * len(d.encode()) <= 6 * len(now.encode()) else ("full", now)


def answers(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """The ledger's answer to each reading of a key, diff text included: the text before comes by a window, the diff in Arrow batches."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.select(*key, *order, F.col(text).alias("now"), F.lag(text).over(w).alias("before"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [ledger_answer(b if isinstance(b, str) else None, n or "") for b, n in zip(p["before"], p["now"], strict=True)]
            yield p.drop(columns=["now", "before"]).assign(state=[g[0] for g in got], answer=[g[1] for g in got])

    kinds = dict(df.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*key, *order]) + ", state string, answer string")
