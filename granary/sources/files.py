"""Sources: file trees, tables of a directory, documents, web pages, coverage reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def read_tree(spark: SparkSession, root: str, glob: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, ext, content, size_bytes, mtime) of the text files under a root; binary extensions are not read, nor larger files where a bound is given (context packs give 1 MiB)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    kept = files.where(~T.is_binary_path(F.col("path")))
    kept = kept if most_bytes is None else kept.where(F.col("length") <= most_bytes)
    content = F.expr("try_validate_utf8(cast(content as string))")
    out = kept.select(F.col("path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), content.alias("content"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime"))
    return out.where("content is not null")


def within(path: Column, root: str) -> Column:
    """Whether a path lies under a root and does not climb out of it."""
    base = root.rstrip("/") + "/"
    return path.startswith(base) & ~F.arrays_overlap(F.split(F.substring(path, len(base) + 1, 100000), "/"), F.array(F.lit("..")))


def first_present(candidates: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """Of files (path, …) those of the first candidate name present in each directory, in the order given."""
    table = F.create_map(*[x for i, n in enumerate(candidates) for x in (F.lit(n), F.lit(i))])
    name = F.element_at(F.split("path", "/"), -1)
    ranked = files.withColumn("priority", F.try_element_at(table, name)).where("priority is not null").withColumn("dir", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1))
    return ranked.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("priority", "path"))).where("n = 1").drop("n")


# Parts of a path, or endings of a name, that mark tests.
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "fixtures", "testdata", "e2e", "benches", "examples"]


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in TEST_DIRS])) | path.rlike(r"(_test\.(go|py|rs)|\.(test|spec)\.[jt]sx?|(^|/)test_[^/]*\.py|Tests?\.(java|kt|cs))$")


# What a lower-case path holds that the impact analysis takes for a test.
TEST_PARTS = ["/test", "/tests/", "/spec/", "_test.", ".test.", ".spec."]


def is_test_file(path: Column) -> Column:
    """The impact analysis' own rule, another than ``is_test_path``: by what the path holds."""
    low = F.lower(path)
    out = low.endswith("_spec.rb")
    for x in TEST_PARTS:
        out = out | F.contains(low, F.lit(x))
    return out


# How a test is named after a file's stem, and the folders whose files need only hold the stem.
RELATED = ["%s.test.", "%s.spec.", "%s_test.", "test_%s", "%sTest.", "%sSpec."]
RELATED_DIRS = ["tests", "test", "__tests__", "spec", "__spec__"]


def related_tests(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, test): files whose name holds one of six patterns of a changed file's stem, or the stem itself within a test folder.

    All parts of the names of possible tests (short strings) meet the patterns by hash, not pair by pair.
    """
    name = lambda p: F.regexp_extract(p, r"([^/]+)$", 1)
    stem = F.regexp_replace(name("path"), r"\.[^.]*$", "")
    asked = changed.select("path", stem.alias("s")).where(F.length("s") > 0).distinct()
    patterns = [F.struct(F.lower(F.format_string(x, "s")).alias("part"), F.lit(False).alias("inside")) for x in RELATED] + [F.struct(F.lower("s").alias("part"), F.lit(True).alias("inside"))]
    wanted = asked.select("path", F.inline(F.array(*patterns)))
    folders = F.split("path", "/")
    within = F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(x) for x in RELATED_DIRS]))
    tests = files.select(F.col("path").alias("test"), F.lower(name("path")).alias("n"), within.alias("within")).distinct().where(F.col("within") | F.col("n").rlike("test|spec"))
    places = F.sequence(F.lit(1), F.greatest(F.length("n"), F.lit(1)))
    every = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.length("n") - i + 1), lambda k: F.substring(F.col("n"), i, k)))))
    parts = tests.select("test", "within", F.explode(every).alias("part"))
    return wanted.join(parts, "part").where("path <> test and (within or not inside)").select("path", "test").distinct()


# Files of the root that are listed as resources, and stems of entry points.
ROOT_FILES = ["README.md", "README.ja.md", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "requirements.txt", "tsconfig.json"]
ENTRY_STEMS = ["main", "lib", "index", "app", "server", "mod", "__init__", "cli"]


def resources(paths: DataFrame, path: str = "path", depth: int = 3, most: int = 30) -> DataFrame:
    """(path, uri): known files of the root, then entry points down to a depth, as many as a listing shows."""
    p = F.col(path)
    level = F.size(F.split(p, "/"))
    name = F.element_at(F.split(p, "/"), -1)
    entry = F.regexp_replace(name, r"\.[^.]*$", "").isin(ENTRY_STEMS) & T.is_code(p, "digest") & (level <= depth)
    known = (level == 1) & name.isin(ROOT_FILES)
    kept = paths.where(known | entry).select(p.alias("path"), F.concat(F.lit("file:///"), p).alias("uri"), known.alias("known"))
    return kept.orderBy(F.col("known").desc(), F.size(F.split("path", "/")), "path").limit(most).drop("known")


def write_once(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet") -> None:
    """Write a table, refusing to replace one unless told to."""
    df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists").save(path)


def write_versions(df: DataFrame, path: str, by: str) -> None:
    """Write a table partitioned by a version; only the versions in ``df`` are replaced."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)
