"""Registered queries against their SQL in DuckDB, and streams against batches."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from granary.plans import registry
from granary.streaming import ledger

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in names)
    assert sorted(duck.sql(registry.ORACLE_SQL[name]).columns) == names
    want = duck.sql(f"select {listed} from ({registry.ORACLE_SQL[name]}) z").fetchall()
    assert plain(map(tuple, df.select(*names).collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    """On tables large enough to hold something for each query (the smallest ones have no security finding)."""
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_context_pack_tries_every_matching_line(spark, tmp_path):
    text = "\n".join([*["license " * 99] * 250, "license"])  # 198 tokens a line, and 1
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = registry.QUERIES["context_pack"](spark, str(tmp_path)).first()
    assert (r.taken, r.used, r.omitted) == (11, 1981, 240)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 4
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_no_other_module_needs_the_llm_folder():
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    for folder, _, names in os.walk(os.path.join(root, "granary")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert "granary.llm" not in f.read()


def test_streamed_run_delta_equals_batch(spark, tmp_path):
    from granary.operators import delta

    runs = [("k", 1, ["a", "b"]), ("k", 2, ["b"]), ("j", 1, []), ("k", 3, ["b", "c"])]
    schema = "k string, n long, messages array<string>"
    for i in range(1, 4):
        spark.createDataFrame([r for r in runs if r[1] == i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ledger.drained(ledger.run_delta(s, "k", "n", "messages", keep_ms=None))
    want = delta.run_delta(spark.createDataFrame(runs, schema), ["k"], "n")
    assert sorted(map(tuple, got.select("k", "n", "new", "resolved", "unchanged").collect())) == sorted(map(tuple, want.collect()))
