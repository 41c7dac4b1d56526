"""Ranked search against every document scored in turn."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from granary.llm import lexical_search as L
from granary.llm import oracle
from granary.llm import queries as Q

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def by_scoring(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * big_n // big_l
            scored.append((sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked.items() if t in c), i))
        scored = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scored)]
    return out


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_query_equals_scoring_and_sql(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    out = Q.op11_lexical_search(spark, sf)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.schema["rank"].dataType.simpleString() == "int"
    got = out.collect()
    assert key(got) == key(by_scoring(docs, items))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert key(got) == key(con.sql(oracle.SQL["op11_lexical_search"]).fetchall())


@pytest.mark.parametrize("bounds", [{}, {"SHARD_TERMS": 30, "BLOCK_TERMS": 3, "KEPT_QUERIES": 1}, {"SHARD_DOCS": 2, "BROADCAST_ROWS": 0}])
def test_odd_rows(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(L, name, value)
    docs = [(1, None), (2, ""), (3, " ,;! "), (4, "Wort ÉCOLE école x1"), (4, "wort again"), (None, "wort"), (5, "wort"), (6, "wort"), (7, "wort wort 漢字"), (8, "long " * 50_000 + "wort"), (9, "none of it")]
    docs += [(i, "same text of wort") for i in range(20, 50)]
    items = [(1, "Wort"), (1, "Wort"), (2, None), (3, ""), (4, "absent terms only zz"), (None, "école 漢字 x1"), (6, "ÉCOLE"), (7, "same " * 4000 + "wort long")]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id bigint, text string, term string, ids string").repartition(3)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, q int")
    got = L.search(L.build(df), it, k=10).collect()
    assert key(got) == key(by_scoring(docs, items))
    assert L.search(L.build(df.limit(0)), it).collect() == [] and L.search(L.build(df), it.limit(0)).collect() == []


def test_ids_of_another_kind_and_other_names(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", "two one"), ("c", "two")], "key string, body string")
    got = L.search(L.build(df, text="body", id="key"), df, k=2, text="body", id="key", doc_id="found").collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: (r[0], r[1]))] == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, "a"), ("b", 2, "b"), ("c", 1, "c"), ("c", 2, "a")]


def test_ties_at_the_edge_are_taken_from_the_front():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sums, k = rng.integers(0, 4, rng.integers(0, 30)), int(rng.integers(1, 12))
        want = [i for i in sorted(range(len(sums)), key=lambda i: (-sums[i], i)) if sums[i] > 0][:k]
        assert sorted(L.best(sums, k).tolist()) == sorted(want)


def test_row_groups_of_shards_are_bounded(spark, sf, monkeypatch, tmp_path):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(L, "SHARD_TERMS", 500)
    monkeypatch.setattr(L, "GROUP_BYTES", 1 << 16)
    index = L.build(spark.read.parquet(f"{sf}/documents.parquet").coalesce(1))
    files = glob.glob(index.shards.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet")
    parts = [pq.ParquetFile(f).metadata.row_group(i) for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(g.num_rows for g in parts) > 100 and len(parts) > 8
    assert max(g.total_byte_size for g in parts if g.num_rows > 8) <= 4 * L.GROUP_BYTES
