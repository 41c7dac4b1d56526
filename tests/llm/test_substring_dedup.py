"""Repeated passages against windows compared word by word, and against SQL."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from granary.llm import oracle
from granary.llm import queries as Q
from granary.llm import substring_dedup as S
from granary.llm import wordgrams
from granary.llm.columns import slices


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def by_comparing(rows):
    """(id, words, removed, kept) of each row of (id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 12):
            g = tuple(w[s : s + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - 12) if i is not None and first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(map(repr, out))


def test_query_equals_sql(spark, sf):
    out = Q.op12_substring_dedup(spark, sf)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = out.collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(oracle.SQL["op12_substring_dedup"]).fetchall())
    assert sum(r.n_removed > 0 for r in got) > 5


def sample():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢字", "A", "a"]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (13, 14, 20, 60)]
    rows = []
    for i in range(60):
        parts = [rng.choice([*passage, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(100 + i, passage[3]) for i in range(30)] + [(150 + i, f"before{i} {passage[0]} after{i}") for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one word"), (None, passage[3]), (None, passage[2]), (204, passage[2].upper())]
    rows += [(205, "again " * 3000), (206, "again " * 20), (206, "again " * 20), (206, passage[1]), (5, passage[1]), (207, "x" * 20_000 + " " + passage[0])]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"HOT_ROWS": 12}, {"HOT_ROWS": 3, "BUCKET_ROWS": 5, "HEAVY_SHARE": 20}, {"HOT_ROWS": 0}, {"LONGEST": 2, "rows": 0}])
def test_rows_equal_those_of_comparing(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        if name == "rows":
            monkeypatch.setattr(wordgrams, "BROADCAST_ROWS", value)
        else:
            monkeypatch.setattr(S, name, value)
    rows = sample()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, kept string, id int").repartition(5)
    out = S.without_repeats(df)
    assert out.columns == ["doc_id", "text", "id", "n_words", "n_removed", "kept"]
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in out.collect()) == by_comparing(rows)


def test_empty_tables_and_ids_of_another_kind(spark):
    df = spark.createDataFrame([("b", "p " * 13), ("a", "p " * 14)], "doc_id string, text string")
    assert S.without_repeats(df.limit(0)).collect() == []
    assert sorted((r.doc_id, r.n_removed) for r in S.without_repeats(df).collect()) == [("a", 0), ("b", 13)]


def test_windows_of_a_super_kmer_share_the_minimiser():
    rng = np.random.default_rng(2)
    for n in (13, 14, 100, 5000):
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        least = S.minimisers(hashes)
        assert len(least) == n - 12
        begins = S.stretches(least)
        for a, b in zip(begins, [*begins[1:], len(least)], strict=True):
            assert len(set(least[a:b].tolist())) == 1 and b - a <= S.LONGEST
        assert n < 1000 or 4.5 < len(least) / len(begins) < 6.5


def test_hashes_and_windows_of_words():
    texts = ["a bb a ccc bb", "bb", "x " * 40, "é 漢字 a bb"]
    of = {}
    for text in texts:
        words = S.words_of(text)
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        for word, h in zip(words, S._Hashes().of(whole, ends).tolist(), strict=True):
            assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of) == 6
    words = [b"w%d" % i for i in range(20)]
    assert S.windows_of(b" ".join(words)) == [b" ".join(words[i : i + 13]) for i in range(8)]


def test_texts_that_lose_nothing_are_not_shuffled(spark, sf, monkeypatch):
    """Beyond a broadcast the plan keeps rows without a list apart from the join."""
    monkeypatch.setattr(wordgrams, "BROADCAST_ROWS", 0)
    docs = wordgrams.keyed(spark.read.parquet(f"{sf}/documents.parquet"), "text", "doc_id")
    lists = S.written(docs.where("id % 7 = 0").selectExpr("id", "text_key", "array(1) as gone"))
    out = wordgrams.with_lists(docs, lists, "gone")
    parts = out._jdf.queryExecution().optimizedPlan().children()
    assert [parts.apply(i).collectLeaves().size() for i in range(parts.size())] == [2, 1]
    assert out.where("gone is not null").count() == lists.count() and out.count() == docs.count()


def test_one_python_worker_a_task(spark, monkeypatch):
    plans = []
    keep = S.written
    monkeypatch.setattr(S, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    monkeypatch.setattr(S, "HOT_ROWS", 12)
    df = spark.createDataFrame(sample(), "doc_id bigint, text string")
    S.passages(df)
    assert len(plans) == 4 and all(p.count("MapInArrow") <= 1 for p in plans)


def test_stretches_are_merged_as_numbers(spark):
    spans = spark.createDataFrame([(1, 7, 5, 18), (1, 7, 0, 5), (1, 7, 40, 53), (1, 7, 45, 60), (1, 7, 45, 60), (2, 7, 3, 2**31 - 1)], "id bigint, text_key bigint, start int, end int")
    out = S.merged(spans)
    assert "struct" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert sorted((r.id, r.gone) for r in out.collect()) == [(1, [0, 18, 40, 60]), (2, [3, 2**31 - 1])]


def test_what_is_taken_at_once_is_bounded():
    batch = pa.RecordBatch.from_pydict({"id": list(range(400)), "text_key": [0] * 400, "t": [" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(400)]})
    parts = list(slices(batch, S.TAKEN_BYTES))
    assert sum(p.num_rows for p in parts) == 400 and max(p.nbytes for p in parts) < 1.1 * (2 << 20)
