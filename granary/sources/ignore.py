"""Ignore rules of file trees: which of many paths a walk passes over.

Rules come from the ignore files of each folder, in order. A rule counts for what lies under its folder; of those that match an
entry the last one of the deepest folder decides, and ``!`` takes an entry back. What lies in an ignored folder is ignored whatever
its own rules say. ``.ignore`` files go before ``.gitignore`` files.

Paths meet rules by hash, on the folders above them: folders are decided once each, not once a file, and only entries
under a folder with rules meet any. A pattern is turned into an expression once a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The files that hold rules, the ones that count least first.
IGNORE_FILES = (".gitignore", ".ignore")


def pattern_of(line: str | None) -> tuple[str, bool, bool] | None:
    """(expression over the path from the rule's folder, negated, folders only) of a line; None where it holds no rule."""
    line = (line or "").rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    return ("" if anchored else "(?:.*/)?") + _expression(line), negated, folders


def _expression(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and out.endswith("/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out += "[^/]*"
            i += 1
            while glob.startswith("*", i):
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = glob[i + 1 : end]
            inner = "^" + inner[1:] if inner[:1] in ("!", "^") else inner
            out, i = out + "(?!/)[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]", end + 1
        else:
            i += c == "\\" and i + 1 < len(glob)
            out += "\\" + glob[i] if not glob[i].isalnum() and glob[i].isascii() else glob[i]
            i += 1
    return out


def rules(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(folder, weight, n, expression, negated, folders): the rules of the ignore files among ``files``; a folder ends with a slash, the root is empty."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    held = files.where(name.isin(*IGNORE_FILES)).select(F.regexp_extract(F.col(path), r"^(.*/)?[^/]*$", 1).alias("folder"), F.array_position(F.array(*[F.lit(x) for x in IGNORE_FILES]), name).cast("int").alias("weight"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.assign(found=[pattern_of(x) for x in p["line"]]).dropna(subset=["found"])
            yield p.drop(columns=["line", "found"]).assign(**{c: [x[i] for x in p["found"]] for i, c in enumerate(("expression", "negated", "folders"))})

    return held.mapInPandas(run, "folder string, weight int, n int, expression string, negated boolean, folders boolean")


def _above(path: Column) -> Column:
    """The folders over a path, each with its slash, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))


def _decided(entries: DataFrame, found: DataFrame, folder: bool) -> DataFrame:
    """The entries (entry) that their own rules ignore."""
    asked = entries.select("entry", F.explode(_above(F.col("entry"))).alias("folder"))
    met = asked.join(found if folder else found.where("not folders"), "folder")
    rest = F.expr("substring(entry, length(folder) + 1)")
    hit = met.where(F.regexp_like(rest, F.concat(F.lit("(?s)^(?:"), "expression", F.lit(")$"))))
    last = hit.groupBy("entry").agg(F.max_by("negated", F.struct("weight", F.length("folder"), "n")).alias("negated"))
    return last.where("not negated").select("entry")


def walked(files: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """The rows of ``files`` that no rule of ``found`` ignores, nor any folder above them; paths are relative to the root. A null path stays out."""
    paths = files.select(F.col(path).alias("entry")).where("entry is not null").distinct()
    folders = paths.select(F.explode(F.slice(_above(F.col("entry")), F.lit(2), F.size(F.split("entry", "/")))).alias("f")).distinct().select(F.regexp_replace("f", "/$", "").alias("entry"))
    gone_folders = _decided(folders, found, True)
    gone = _decided(paths, found, False)
    under = paths.select("entry", F.explode(F.transform(_above(F.col("entry")), lambda x: F.regexp_replace(x, "/$", ""))).alias("f")).join(gone_folders.withColumnRenamed("entry", "f"), "f", "left_semi").select("entry")
    out = gone.unionByName(under).distinct()
    return files.where(F.col(path).isNotNull()).join(out.withColumnRenamed("entry", path), path, "left_anti")


def walk(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` (path, text, …) without what the ignore files among them pass over."""
    return walked(files, rules(files, path, text), path)
