"""Calls bound to definitions through scopes and imports, and what is reached through them.

A call does not meet every definition of its name: it asks for a few (file, owner, name), in this order, and
the first that is defined takes it:

1. with the receiver self, this, cls or Self: a member of the caller's own class in its file;
2. without a receiver: what is defined within the caller, beside it in its class's file, or at the top of the file;
3. the name as an import brings it in (under an alias, too), in the file that the import points to;
4. with another receiver: a member of that class, in the file or in the file that brings the class in, or a function of the
   file that is imported under the receiver's name.

So all of it is one equi-join of a handful of keys a call, however many files define a name. Calls that stay
unbound tell how many definitions of the name there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import relations
from granary.operators.symbols import symbol_id
from granary.session import spread, written
from granary.sources import code, extract

# Receivers that stand for the object or class at hand; groups of files that ask for a name's definitions together.
SELVES = ("self", "this", "cls", "Self")
GROUPS = 256


def _ext(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path else ""


#: Rows of ``_read``: a definition ("d": name, owner, kind, first and last line), a call ("c": the callee's name, the caller's owner and lines) or an import ("i").
READ = "what string, name string, owner string, kind string, first int, last int, line int, receiver string, caller string, raw string, resolved string, symbols string"


def _parser(path: str) -> Callable[[str], list[tuple]]:
    programs, deps = code.definitions_and_calls(_ext(path)), extract.code_deps(path)

    def tried(parse: Callable, none, text: str):
        try:
            return parse(text)
        except Exception:  # what one parser cannot read, the other may
            return none

    def parse(text: str) -> list[tuple]:
        defined, called = tried(programs, ([], []), text)
        out = [("d", name, owner, kind, first, last, *(None,) * 6) for kind, name, _, first, last, owner in defined]
        out += [("c", callee, owner, None, first, last, line, receiver, caller, *(None,) * 3) for line, callee, receiver, caller, owner, first, last in called]
        return out + [("i", *(None,) * 8, raw, resolved, symbols) for raw, _, resolved, symbols in tried(deps, [], text)]

    return parse


def _read(files: DataFrame, path: str, text: str) -> DataFrame:
    """(file, n, ...) of definitions, calls and imports, from one reading of each text; a file without any has a row of nulls."""
    return extract.rows_by_path(files.select(F.col(path).alias("file"), F.col(text).alias("text")), ["file"], "file", "text", _parser, READ, empty=True)


def call_sites(read: DataFrame) -> DataFrame:
    """(file, line, callee, receiver, caller, caller_owner, caller_start, caller_end) of all calls but those of keywords and names in capitals."""
    rows = read.where("what = 'c'").select("file", "line", F.col("name").alias("callee"), "receiver", "caller", F.col("owner").alias("caller_owner"), F.col("first").alias("caller_start"), F.col("last").alias("caller_end"))
    return rows.where(~F.col("callee").isin(*relations.NO_CALLS))


def imported(read: DataFrame) -> DataFrame:
    """(file, local, original, target): each name that an import with a known target brings into a file; of a whole module the original is null (a name that a Python package brings in may be either)."""
    rows = read.where("what = 'i' and resolved is not null")
    alias = lambda name: F.call_function("regexp_extract", F.col("raw"), F.concat(F.lit(r"\b"), name, F.lit(r"\s+as\s+(\w+)")), F.lit(1))
    given = rows.select("file", "raw", F.col("resolved").alias("target"), F.explode(F.filter(F.split("symbols", r"\s*,\s*"), lambda x: x != "")).alias("original"))
    names = given.select("file", F.coalesce(F.nullif(alias(F.col("original")), F.lit("")), F.col("original")).alias("local"), "original", "target")
    stem = F.regexp_extract("resolved", r"([^/]+?)(?:\.[^./]*)?$", 1)
    whole = rows.where("symbols = ''").select("file", F.coalesce(F.nullif(F.regexp_extract("raw", r"\bas\s+(\w+)\s*(?:from\b.*)?;?\s*$", 1), F.lit("")), stem).alias("local"), F.lit(None).cast("string").alias("original"), F.col("resolved").alias("target"))
    modules = given.select("file", F.regexp_extract("target", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("local"), F.lit(None).cast("string").alias("original"), "target")
    within = names.where("target like '%.py'").select("file", "local", F.lit(None).cast("string").alias("original"), F.concat(F.regexp_replace("target", r"\.py$", "/"), "original", F.lit(".py")).alias("target"))
    return names.unionByName(whole).unionByName(modules).unionByName(within.where("local is not null")).distinct()


def bound_calls(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file, caller, caller_id, callee, callee_file, callee_id, first_line, calls, ambiguous): calls of each definition by callee; an unbound one has no file, and ``ambiguous`` definitions of its name.

    Texts are read once, in one Python worker a task, and what is read is written. All joins are by merge: some bytes of
    files or of Parquet come to millions of rows.
    """
    read = written(_read(files, path, text))
    defined = read.where("what = 'd' and kind not in ('impl', 'namespace', 'mod')").select(F.col("file").alias("in_file"), "name", F.coalesce("owner", F.lit("")).alias("in_owner"), symbol_id(F.col("kind"), F.col("first"), F.col("last")).alias("callee_id"))
    brought = imported(read)
    by_name = brought.where("original is not null").groupBy("file", "local").agg(F.min(F.struct("target", "original")).alias("at"))
    paths = read.where("coalesce(n, 0) = 0").select(F.col("file").alias("target"))
    by_module = brought.where("original is null").join(paths.hint("merge"), "target", "left_semi").groupBy("file", "local").agg(F.min("target").alias("target"))
    sites = call_sites(read).where("caller is not null")
    own = ~F.col("receiver").isNull() & F.col("receiver").isin(*SELVES)
    plain = F.col("receiver").isNull()
    asked = F.when(plain, F.col("callee")).otherwise(F.col("receiver"))
    rows = spread(sites.withColumn("asked", asked), "file", "asked")
    for names in (by_name, by_module):
        rows = rows.join(names.withColumnRenamed("local", "asked").hint("merge"), ["file", "asked"], "left")

    def ask(rank: int, when: Column, file: Column, owner: Column, name: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("rank"), file.alias("in_file"), owner.alias("in_owner"), name.alias("name")))

    file, callee, none = F.col("file"), F.col("callee"), F.lit("")
    keys = F.array_compact(
        F.array(
            ask(1, own & F.col("caller_owner").isNotNull(), file, F.col("caller_owner"), callee),
            ask(2, plain, file, F.col("caller"), callee),
            ask(3, plain & F.col("caller_owner").isNotNull(), file, F.col("caller_owner"), callee),
            ask(4, plain, file, none, callee),
            ask(5, plain & F.col("at").isNotNull(), F.col("at.target"), none, F.col("at.original")),
            ask(6, ~plain & ~own, file, F.col("receiver"), callee),
            ask(7, ~plain & F.col("at").isNotNull(), F.col("at.target"), F.col("at.original"), callee),
            ask(8, ~plain & F.col("target").isNotNull(), F.col("target"), none, callee),
        )
    )
    caller_id = F.concat("file", F.lit("#"), "caller_start", F.lit("-"), "caller_end")
    found = rows.select("file", "line", "callee", "receiver", "caller", caller_id.alias("caller_id"), F.explode_outer(keys).alias("k"))
    met = spread(found.select("*", F.coalesce("k.in_file", "file").alias("in_file"), "k.in_owner", "k.name", "k.rank").drop("k"), "in_file", "in_owner", "name").join(spread(defined, "in_file", "in_owner", "name").hint("merge"), ["in_file", "in_owner", "name"], "left")
    site = ["file", "caller", "caller_id", "callee", "line", "receiver"]
    best = met.groupBy(*site).agg(F.min(F.when(F.col("callee_id").isNotNull(), F.struct("rank", "in_file", "callee_id"))).alias("to"))
    by = best.groupBy("file", "caller", "caller_id", "callee", F.col("to.in_file").alias("callee_file"), F.concat("to.in_file", F.lit("#"), F.regexp_extract("to.callee_id", r":(.*)$", 1)).alias("callee_id")).agg(F.min("line").alias("first_line"), F.count("*").alias("calls"))
    return _with_namesakes(written(by), defined)


def _with_namesakes(by: DataFrame, defined: DataFrame) -> DataFrame:
    """Unbound calls with the definitions of their names; a name that very many files call is asked for by some of them together, or all its rows meet in a task."""
    columns = ["file", "caller", "caller_id", "callee", "callee_file", "callee_id", "first_line", "calls"]
    named = defined.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("held"))
    loose = by.where("callee_file is null").withColumn("callee_id", F.lit(None).cast("string")).withColumn("some", F.pmod(F.hash("file"), F.lit(GROUPS)))
    held = loose.select("callee", "some").distinct().join(named.hint("merge"), "callee")
    out = spread(loose, "callee", "some").join(spread(held, "callee", "some").hint("merge"), ["callee", "some"], "left")
    none = F.lit(0).cast("bigint")
    return by.where("callee_file is not null").select(*columns, none.alias("ambiguous")).unionByName(out.select(*columns, F.coalesce("held", none).alias("ambiguous")))


def reached(bound: DataFrame, start: DataFrame, depth: int = 5, callers: bool = False) -> DataFrame:
    """(node, hops) within up to five calls of the start nodes (node: file#first-last line), or with ``callers`` of what calls them; cycles end by themselves."""
    edges = bound.where("callee_id is not null").select(F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee")).where("caller <> callee").distinct()
    edges = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")) if callers else edges
    return relations.reachable(written(edges), start, min(depth, 5))


