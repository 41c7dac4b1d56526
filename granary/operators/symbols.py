"""Operators on symbols named by ``kind:start-end``: bodies, zooms, patches, moves, digests.

Texts stay whole rows, and lines are taken out of them as slices of an array, so nothing is exploded
or shuffled to read or change a few lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.sources import code, extract

_ID = r"^([A-Za-z_]+):(\d+)-(\d+)$"


def parse_id(id: Column) -> Column:
    """kind:start-end as a struct (kind, start, end); null where an id has another form."""
    ok = id.rlike(_ID)
    part = lambda i: F.regexp_extract(id, _ID, i)
    return F.when(ok, F.struct(part(1).alias("kind"), F.try_to_number(part(2), F.lit("999999999")).cast("bigint").alias("start"), F.try_to_number(part(3), F.lit("999999999")).cast("bigint").alias("end")))


def parse_range(value: Column) -> Column:
    """start-end as a struct (start, end); null where it is none or runs backwards."""
    p = r"^(\d{1,9})-(\d{1,9})$"
    start, end = (F.regexp_extract(value, p, i).try_cast("bigint") for i in (1, 2))
    return F.when(value.rlike(p) & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def symbol_id(kind: Column, start: Column, end: Column) -> Column:
    return F.concat(kind, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def symbols_of(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, kind, name, signature, start, end, owner, id) of all definitions, by the grammar of each path's extension."""
    rows = extract.rows_by_path(files.select(F.col(path).alias("path"), F.col(text).alias("text")), ["path"], "path", "text", lambda p: code.definitions(p.rsplit(".", 1)[-1].lower() if "." in p else ""), code.SYMBOLS).where("error is null")
    longs = rows.select("path", "kind", "name", "signature", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "owner")
    return longs.withColumn("id", symbol_id(F.col("kind"), F.col("start"), F.col("end")))


def bodies(files: DataFrame, asked: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, id, body) for asked rows (path, id): the lines of the id joined, or an "Error: …" where the id is none or lies outside the text."""
    rows = asked.groupBy("path").agg(F.collect_set("id").alias("ids")).join(files.select(F.col(path).alias("path"), F.col(text).alias("text")), "path")
    all_lines = rows.select("path", T.lines("text").alias("lines"), F.explode("ids").alias("id")).withColumn("at", parse_id(F.col("id")))
    fits = (F.col("at.start") >= 1) & (F.col("at.start") <= F.col("at.end")) & (F.col("at.end") <= F.size("lines"))
    body = F.array_join(F.slice("lines", F.col("at.start").cast("int"), (F.col("at.end") - F.col("at.start") + 1).cast("int")), "\n")
    return all_lines.select("path", "id", F.when(F.col("at").isNull(), F.concat(F.lit("Error: invalid id "), F.col("id"))).when(~fits, F.concat(F.lit("Error: out of range "), F.col("id"))).otherwise(body).alias("body"))


def zoomed(files: DataFrame, symbols: DataFrame, zoom: str, path: str = "path", text: str = "text") -> DataFrame:
    """(path, id, shown) of symbols at a zoom: skeleton (signatures), sketch (outlines of bodies) or body."""
    if zoom == "skeleton":
        return symbols.select("path", "id", F.col("signature").alias("shown"))
    got = bodies(files, symbols.select("path", "id"), path, text)
    if zoom == "body":
        return got.withColumnRenamed("body", "shown")
    from granary.operators import lines

    rows = lines.sketch(lines.explode_lines(got, ["path", "id"], "body"), ["path", "id"])
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("path", "id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("shown"))


def _replaced(text: Column, start: Column, end: Column, new: Column) -> Column:
    """A text with its lines start to end replaced by an array of lines; carriage returns stay as the text has them."""
    parts = F.split(text, "\n", -1)
    cr = F.when(F.contains(text, F.lit("\r\n")), F.lit("\r")).otherwise(F.lit(""))
    own = F.transform(new, lambda x: F.concat(x, cr))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), (start - 1).cast("int")), own, F.slice(parts, (end + 1).cast("int"), F.greatest(F.size(parts) - end, F.lit(0)).cast("int"))), "\n")


def patch_symbol(files: DataFrame, patches: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text, state) for patches (path, id, expected_name, new_body): the id's lines replaced.

    A patch whose first line does not hold the expected name (null: any) is "stale", one whose id is
    none or lies outside is "invalid"; both leave the text. One patch a path; see ``rewrite.apply_edits``
    for edits by text.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).join(patches, "path").withColumn("at", parse_id(F.col("id"))).withColumn("lines", T.lines("text"))
    fits = F.col("at").isNotNull() & (F.col("at.start") >= 1) & (F.col("at.start") <= F.col("at.end")) & (F.col("at.end") <= F.size("lines"))
    named = F.col("expected_name").isNull() | F.contains(F.get("lines", (F.col("at.start") - 1).cast("int")), F.col("expected_name"))
    state = F.when(~fits, "invalid").when(~F.coalesce(named, F.lit(False)), "stale").otherwise("patched")
    done = _replaced(F.col("text"), F.col("at.start"), F.col("at.end"), F.split("new_body", "\r?\n", -1))
    return rows.withColumn("state", state).select("path", F.when(F.col("state") == "patched", done).otherwise(F.col("text")).alias("text"), "state")


def delete_symbol(files: DataFrame, asked: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text, removed) for (path, id): the id's lines and one blank line after them taken out."""
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).join(asked, "path").withColumn("at", parse_id(F.col("id"))).withColumn("lines", F.split("text", "\n", -1))
    blank = F.coalesce(F.trim(F.regexp_replace(F.get("lines", F.col("at.end").cast("int")), "\r$", "")) == "", F.lit(False)) & (F.col("at.end") < F.size("lines") - 1)
    end = F.col("at.end") + blank.cast("bigint")
    kept = F.array_join(F.concat(F.slice("lines", F.lit(1), (F.col("at.start") - 1).cast("int")), F.slice("lines", (end + 1).cast("int"), F.greatest(F.size("lines") - end, F.lit(0)).cast("int"))), "\n")
    cut = F.array_join(F.slice("lines", F.col("at.start").cast("int"), (F.col("at.end") - F.col("at.start") + 1).cast("int")), "\n")
    return rows.where("at is not null").select("path", kept.alias("text"), cut.alias("removed"))


def insert_symbol(files: DataFrame, asked: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text) for (path, mode, id, body): a body put before or after an id's lines, or at the start or end of the text."""
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).join(asked, "path").withColumn("at", parse_id(F.col("id"))).withColumn("lines", F.split("text", "\n", -1))
    after = F.when(F.col("mode") == "before", F.col("at.start") - 1).when(F.col("mode") == "after", F.col("at.end")).when(F.col("mode") == "start", F.lit(0)).otherwise(F.size("lines"))
    at = after.cast("int")
    return rows.select("path", F.array_join(F.concat(F.slice("lines", F.lit(1), at), F.split("body", "\n", -1), F.slice("lines", at + 1, F.size("lines"))), "\n").alias("text"))


def move_symbol(files: DataFrame, moves: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text, referencing) for moves (source, id, name, target): the source without the symbol, the target with it at its end, and the other files that mention the name."""
    whole = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    cut = delete_symbol(whole, moves.select(F.col("source").alias("path"), "id"))
    moved = moves.join(cut.select(F.col("path").alias("source"), F.col("text").alias("rest"), "removed"), "source")
    asked = moves.select("source", "target", "name").distinct()
    words = whole.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0)))).alias("name"))
    refs = words.join(asked, "name").where("path <> source and path <> target").groupBy("source", "target", "name").agg(F.array_sort(F.collect_set("path")).alias("referencing"))
    told = moved.join(refs, ["source", "target", "name"], "left").withColumn("referencing", F.coalesce("referencing", F.array().cast("array<string>")))
    sources = told.select(F.col("source").alias("path"), F.col("rest").alias("text"), "referencing")
    gap = F.when((F.col("text") == "") | F.col("text").endswith("\n\n"), "").when(F.col("text").endswith("\n"), "\n").otherwise("\n\n")
    targets = whole.join(told.select(F.col("target").alias("path"), "removed", "referencing"), "path").select("path", F.concat("text", gap, "removed", F.lit("\n")).alias("text"), "referencing")
    return sources.unionByName(targets)


def entry_points(files: DataFrame, symbols: DataFrame, most: int = 8, signatures: int = 6, path: str = "path") -> DataFrame:
    """(path, score, signatures): the files whose name tells most of an entry point, less their depth, with their first signatures."""
    p = F.col(path)
    stem = F.regexp_extract(p, r"([^/]+?)(?:\.[^./]*)?$", 1)
    scored = files.select(p.alias("path"), (T.name_score(stem) - (F.size(F.split(p, "/")) - 1)).alias("score"), T.name_score(stem).alias("named")).where("named > 0")
    best = scored.orderBy(F.col("score").desc(), "path").limit(most).drop("named")
    first = symbols.join(F.broadcast(best.select("path")), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "signature"))).alias("s"))  # at most ``most`` paths
    shown = F.transform(F.slice("s", 1, signatures), lambda x: x["signature"])
    return best.join(first, "path", "left").select("path", "score", F.coalesce(shown, F.array().cast("array<string>")).alias("signatures"))


def project_digest(files: DataFrame, symbols: DataFrame, budget: int = 2000, path: str = "path", text: str = "text") -> DataFrame:
    """(part, n, line): languages by tokens (eight), entry points with signatures, and the tree to a depth of two within a third of the budget."""
    from granary.operators import stats

    rows = stats.measured(files.select(F.col(path).alias("path"), F.col(text).alias("text"))).withColumn("lang", T.language(F.col("path")))
    return digest_lines(stats.workspace_stats(rows), entry_points(rows, symbols), rows, budget)


def digest_lines(composition: DataFrame, found: DataFrame, paths: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """(part, n, line) from the composition by language, entry points (path, score, signatures) and the paths of all files."""
    from granary.operators import stats

    langs = composition.orderBy(F.col("tokens").desc(), "lang").limit(most)
    from pyspark.sql import Window

    one = Window.orderBy(F.col("tokens").desc(), "lang")  # eight rows
    a = langs.select(F.lit("languages").alias("part"), F.row_number().over(one).cast("bigint").alias("n"), F.format_string("%s: %d files, %d lines, %d tokens (%s%%)", "lang", "files", "lines", "tokens", F.col("pct").cast("string")).alias("line"))
    b = found.select(F.lit("entry points").alias("part"), F.row_number().over(Window.orderBy(F.col("score").desc(), "path")).cast("bigint").alias("n"), F.concat_ws(" | ", F.col("path"), F.col("signatures")).alias("line"))
    tree = stats.directory_tree(paths, "path", 2)
    # a line costs a token at least: no more can fit
    first = stats.rendered_tree(tree).orderBy("entry").limit(max(1, budget // 3))
    order = Window.orderBy("entry")
    shown = first.select(F.row_number().over(order).cast("bigint").alias("n"), F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "line").where(F.col("upto") <= 4 * (budget // 3))
    return a.unionByName(b).unionByName(shown.select(F.lit("tree").alias("part"), "n", "line"))
