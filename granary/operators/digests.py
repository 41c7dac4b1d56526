"""A project's digest, kept by version: a later run measures only files that are new or changed, and sums are subtracted and added."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import stats, symbols
from granary.session import written

#: Changed files, up to which their paths go into the scan of the texts as a filter; beyond it texts and paths are joined.
FILTERED = 1000
#: First signatures of a file that may be an entry point.
SIGNATURES = 6


@dataclass(frozen=True)
class Digest:
    """Written tables: files (path, version, lang, tokens, n_lines, score, signatures), sums (lang, files, lines, tokens); and how many files the last run measured."""

    files: DataFrame
    sums: DataFrame
    measured: int


def _measured(changed: DataFrame, texts: DataFrame, n: int, every: bool) -> DataFrame:
    """Rows of the table of files for the changed paths; where ``every`` text is asked for, texts are measured before they meet the paths and so are not shuffled."""
    if n <= FILTERED:  # reaches the scan, so row groups and files of other paths are passed over
        texts = texts.where(F.col("path").isin([r.path for r in changed.select("path").collect()]))
    texts = texts.select("path", "text")
    held = texts.join(changed, "path")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    measured = stats.measured(texts).join(changed, "path") if every else stats.measured(held)
    rows = measured.withColumn("lang", T.language(F.col("path"))).withColumn("score", F.when(T.name_score(stem) > 0, T.name_score(stem) - (F.size(F.split("path", "/")) - 1)))
    first = symbols.symbols_of(held.where(T.name_score(stem) > 0)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "signature"))).alias("s"))
    shown = F.coalesce(F.transform(F.slice("s", 1, SIGNATURES), lambda x: x["signature"]), F.array().cast("array<string>"))
    return rows.join(first, "path", "left").select("path", "version", "lang", "tokens", "n_lines", "score", shown.alias("signatures"))


def _summed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.groupBy("lang").agg((sign * F.count("*")).alias("files"), (sign * F.sum("n_lines")).alias("lines"), (sign * F.sum("tokens")).alias("tokens"))


def refresh(before: Digest | None, listing: DataFrame, texts: DataFrame) -> Digest:
    """The digest of the files in ``listing`` (path, version), from the one ``before``; ``texts`` (path, text) is read for files that are new or have another version.

    Files that are gone, and the earlier state of changed ones, are subtracted from the sums; what was measured
    is added. Paths are unique. A null text counts as a file without lines or tokens; one without a text row is left out, and asked for again.
    """
    listed = listing.select("path", "version")
    changed, gone = written(listed if before is None else listed.join(before.files, ["path", "version"], "left_anti")), None
    new = written(_measured(changed, texts, changed.count(), before is None))
    if before is None:
        return Digest(new, written(_summed(new, 1)), new.count())
    kept = before.files.join(listed, ["path", "version"], "left_semi")
    gone = before.files.join(listed, ["path", "version"], "left_anti")
    by = before.sums.unionByName(_summed(gone, -1)).unionByName(_summed(new, 1)).groupBy("lang")
    sums = by.agg(*[F.sum(c).alias(c) for c in ("files", "lines", "tokens")]).where("files > 0")
    return Digest(written(kept.unionByName(new)), written(sums), new.count())


def languages(digest: Digest) -> DataFrame:
    """(lang, files, lines, tokens, pct) from the sums alone."""
    return digest.sums.withColumn("pct", T.pct1(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())))  # a row a language


def shown(digest: Digest, budget: int = 2000, most: int = 8) -> DataFrame:
    """(part, n, line) as ``symbols.project_digest`` gives it for all texts, without reading any."""
    best = digest.files.where("score is not null").orderBy(F.col("score").desc(), "path").limit(most).select("path", "score", "signatures")
    return symbols.digest_lines(languages(digest), best, digest.files, budget)
