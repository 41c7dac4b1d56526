"""Factoring by joins against the greedy rule on whole batches."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import delta, factoring
from granary.plans import extras, registry  # noqa: F401


def batches(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for b in range(4):
        kinds = [[f"{b} {k} {rng.random()}" for _ in range(rng.randint(1, 12))] for k in range(5)]
        for i in range(n):
            lines = list(rng.choice(kinds))
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(lines) + 1)
                lines[at : at + rng.randint(0, 2)] = rng.choice([["}"], [f"new {rng.random()}"], [], ["}", "}"]])
            rows.append((b, i * 3 % (3 * n) + b, rng.choice(["\n", "\r\n"]).join(lines)))
    return rows + [(9, 1, None), (9, 2, ""), (9, 3, "only"), (9, 4, "only"), (9, 5, "x\ny\nz\nlast"), (9, 6, "x\ny\nz\nother, and longer than a diff's own lines, which are longer than one may think")]


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_equals_the_greedy_rule(spark, least):
    df = spark.createDataFrame(batches(3, 24), "b int, id int, text string").repartition(6)
    rows = lambda out: sorted(map(repr, map(tuple, out.select("b", "id", "template_ref", "ratio", "diff").collect())))
    got = rows(factoring.factor(df, ["b"], "id", "text", least))
    assert got == rows(delta.factor(df, ["b"], "id", "text", least))
    assert sum("None, None, None" not in r for r in got) > 20


def test_one_large_batch_of_near_copies(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1 as b", "id", "concat(repeat(concat('common to kind ', id % 7, '\n'), 12), 'own ', id, '\n', 'and ', id % 5) as text")
    out = factoring.factor(df, ["b"], "id", "text")
    got = {r.template_ref: r["count"] for r in out.groupBy("template_ref").count().collect()}
    assert got.pop(None) == 7 and got == {k: len(range(k, n, 7)) - 1 for k in range(7)}


def test_empty_and_query(spark):
    none = spark.createDataFrame([], "b int, id int, text string")
    assert factoring.factor(none, ["b"], "id", "text").collect() == []
    assert registry.QUERIES["factored_results"](spark, "/root/testdata/sf0.001").where("template_ref is not null").count() > 0


def test_pairs_are_compared_in_all_parts_of_a_shuffle(spark):
    rows = spark.createDataFrame([(1, i, "the same\nline\n" * 9 + str(i)) for i in range(40)], "b0 int, i int, t string")
    pairs = rows.select("b0", F.lit(0).alias("i"), F.col("i").alias("j")).where("j > 0").coalesce(1)
    out = factoring._agreeing(pairs, rows.coalesce(1), ["b0"], 0.5)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.i, r.j) for r in out.collect()) == [(0, j) for j in range(1, 40)]
