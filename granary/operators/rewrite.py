"""Edits as transforms: each gives the new content and what changed; nothing is written in place."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

IDENTIFIER = re.compile(r"^[A-Za-z_]\w*$")


def rename(lines: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """(key…, line_no, before, after, n): whole-word replacements, line by line."""
    if not IDENTIFIER.match(old) or not IDENTIFIER.match(new):
        raise ValueError("both names must be identifiers")
    word = rf"\b{re.escape(old)}\b"
    hit = lines.where(F.col("line").contains(old) & F.col("line").rlike(word))
    return hit.select(*key, "line_no", F.col("line").alias("before"), F.regexp_replace("line", word, new).alias("after"), F.regexp_count("line", F.lit(word)).cast("bigint").alias("n"))


def apply_edits(df: DataFrame, text: str, edits: list[tuple[str, str]], to: str = "edited") -> DataFrame:
    """Edits (find, replace) in order; each must be found exactly once then, else none of a text's edits holds: columns ``to`` and ``ok``."""
    now, ok = F.col(text), F.lit(True)
    for find, new in edits:
        if not find:
            raise ValueError("nothing to find")
        ok = ok & (T.occurrences(now, find) == 1)
        now = F.replace(now, F.lit(find), F.lit(new))
    return df.withColumn("ok", ok).withColumn(to, F.when(F.col("ok"), now).otherwise(F.col(text)))


def delete_lines(lines: DataFrame, key: list[str], start: int, end: int) -> DataFrame:
    """A text's lines without a range and one blank line after it."""
    blank = (F.col("line_no") == end + 1) & (F.trim("line") == "")
    return lines.where(~F.col("line_no").between(start, end) & ~blank)


def insert_lines(lines: DataFrame, key: list[str], after: int, new: list[str]) -> DataFrame:
    """A text's lines with new ones after a line (0: before all)."""
    at = F.struct(F.col("line_no").alias("a"), F.lit(0).alias("b"))
    own = lines.select(*key, at.alias("at"), "line")
    add = lines.select(*key).distinct().select(*key, F.posexplode(F.array(*[F.lit(x) for x in new])).alias("p", "line")).select(*key, F.struct(F.lit(after).cast("bigint").alias("a"), (F.col("p") + 1).alias("b")).alias("at"), "line")
    return own.unionByName(add)


def joined_lines(rows: DataFrame, key: list[str], order: str, to: str = "text") -> DataFrame:
    """Lines back to texts."""
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias(to))


def edit_imports(text: str, add: list[str], remove: list[str]) -> tuple[str, int, int, int]:
    """Whole import lines taken out and put after the last import: (text, added, removed, skipped)."""
    lines = text.split("\n")
    gone = {r.strip() for r in remove}
    kept = [x for x in lines if x.strip() not in gone or not x.strip()]
    have = {x.strip() for x in kept}
    new: list[str] = []
    for x in add:
        if x.strip() not in have:
            have.add(x.strip())
            new.append(x.strip())
    like = re.compile(r"^\s*(import|from|use|pub use|#include|require|const .*require\(|package)\b")
    last = 0
    for i, x in enumerate(kept):
        if i - last > 5 and last:
            break
        if like.match(x):
            last = i + 1
    return "\n".join([*kept[:last], *new, *kept[last:]]), len(new), len(lines) - len(kept), len(add) - len(new)


def set_value(text: str, path: str, value, kind: str = "json") -> tuple[str, object]:
    """A JSON, YAML or TOML document with a value set at ``a.b[0].c`` and the old value; objects on the way are made, indexes must exist.

    JSON and YAML are written anew in their order; of a TOML document only the line of the key changes.
    """
    parts = re.findall(r"[^.\[\]]+|\[\d+\]", path)
    if kind == "toml":
        return _set_toml(text, parts, value)
    if kind == "yaml":
        import yaml

        tree = yaml.safe_load(text)
        dump = lambda x: yaml.safe_dump(x, sort_keys=False, allow_unicode=True)
    else:
        tree = json.loads(text)
        dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    if not parts:
        return dump(value), tree
    at = tree
    for p in parts[:-1]:
        at = at[int(p[1:-1])] if p[0] == "[" else at.setdefault(p, {})
    last = parts[-1]
    if last[0] == "[":
        old, at[int(last[1:-1])] = at[int(last[1:-1])], value
    else:
        old = at.get(last)
        at[last] = value
    return dump(tree), old


def _set_toml(text: str, parts: list[str], value) -> tuple[str, object]:
    import tomllib

    if not parts or any(p[0] == "[" for p in parts):
        raise ValueError("a key is needed, without an index")
    at = tomllib.loads(text)
    for p in parts[:-1]:
        at = at.get(p, {})
    old, table, key = at.get(parts[-1]), ".".join(parts[:-1]), parts[-1]
    new = f"{key} = {json.dumps(value, ensure_ascii=False)}"
    lines, now, place = text.split("\n"), "", None if table else 0
    for i, line in enumerate(lines):
        if m := re.match(r"\s*\[([^\[\]]+)\]\s*(?:#.*)?$", line):
            now = m[1].strip()
        if now == table:
            if re.match(rf"\s*{re.escape(key)}\s*=", line):
                lines[i] = new
                break
            if line.strip():
                place = i + 1
    else:
        if place is None:
            lines += ["", f"[{table}]", new] if lines[-1].strip() else [f"[{table}]", new]
        else:
            lines.insert(place, new)
    out = "\n".join(lines)
    tomllib.loads(out)  # what cannot be read is not written
    return out, old


def write_section(text: str, anchor: str, mode: str, body: str = "", expected_title: str | None = None) -> str:
    """A Markdown text with a section replaced, deleted, or a body put before, after or at the end of it; the heading must be the expected one, if any."""
    from granary.sources.extract import markdown_headings

    lines = text.split("\n")
    for _, title, a, first, last in markdown_headings(text, setext=False):
        if a == anchor:
            break
    else:
        raise KeyError(anchor)
    if expected_title is not None and expected_title != title:
        raise ValueError(f"the heading is {title!r}")
    new = body.split("\n")
    before, own, after = lines[: first - 1], lines[first - 1 : last], lines[last:]
    gap = lambda x, y: [""] if x and y and x[-1].strip() and y[0].strip() else []
    if mode == "replace":
        mid = [*new, *gap(new, after)]
    elif mode == "delete":
        mid = []
        after = after[1:] if after and not after[0].strip() else after
    elif mode == "insert_before":
        mid = [*gap(before, new), *new, *gap(new, own), *own]
    elif mode in ("insert_after", "append"):
        while mode == "append" and own and not own[-1].strip():
            own = own[:-1]
        mid = [*own, *gap(own, new), *new, *gap(new, after)]
    else:
        raise ValueError(mode)
    return "\n".join([*before, *mid, *after])
