"""Periodic runs against runs found by trying every stretch."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from granary.llm import periodic_runs as P
from granary.llm import queries as Q

SF = "/root/testdata/sf0.001"


def by_reading(words: list) -> list[tuple[int, int, int]]:
    """Every run, by extending every place at every lag."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def smallest_period(words: list) -> int:
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def codes(words) -> np.ndarray:
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


@pytest.mark.parametrize("costs", [(15_000.0, 6.0, 4_000.0, 1.0), (0.0, 0.0, 1e9, 1.0), (1e9, 1e9, 0.0, 0.0)])
def test_runs_equal_those_found_by_reading(costs, monkeypatch):
    for name, value in zip(("STEP", "PAIR", "FFT", "FFT_STEP"), costs, strict=True):
        monkeypatch.setattr(P, name, value)
    monkeypatch.setattr(P, "PROBED", 2)
    rng = random.Random(7)
    some = 0
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcdefghijklmnop"])
        words = []
        for _ in range(rng.randint(0, 5)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
        runs = P.runs_of(codes(words))
        assert runs == by_reading(words), words
        assert all(smallest_period(words[s : s + n]) == q for s, n, q in runs)
        some += bool(runs)
    assert some > 100


def test_counts_of_matches_are_exact():
    rng = np.random.default_rng(3)
    for n in (6, 50, 3000):
        words = rng.zipf(1.3, n) % 97
        counts = P.match_counts(codes(words.tolist()), n // 4)
        assert counts[1:].tolist() == [int((words[q:] == words[:-q]).sum()) for q in range(1, n // 4 + 1)]


def test_long_texts_end_soon():
    one = np.zeros(300_000, np.int64)
    assert P.runs_of(one) == [(0, 300_000, 1)]
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 2, 20_011)
    text = np.concatenate([rng.integers(0, 2, 50_000), np.tile(unit, 5)])
    runs = [r for r in P.runs_of(text) if r[2] == 20_011]
    assert len(runs) == 1 and runs[0][1] >= 5 * 20_011


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = looped(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = by_reading(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_reading(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = Q.op13_periodic_runs(spark, SF)
    assert out.columns == NAMES
    got = {r.doc_id: tuple(r) for r in out.collect()}
    short = {i for i, t in docs.items() if len((t or "").split()) <= 1500}
    assert len(got) == len(docs) and len(short) > 150
    assert {i: got[i] for i in short} == {i: expected(i, docs[i]) for i in short}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, " \t\n ", None), (None, "a a a a a a a", "n"), (10, "z z " * 9, "u"), (11, "a b " * 20_000, "long"), (12, "no loop here at all", "")]
    rows += [(i, "one two three four five six seven eight nine ten " * 2, "l") for i in range(20, 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    folder = str(tmp_path / "t")
    df.write.parquet(f"{folder}/documents.parquet")
    got = sorted(tuple(r) for r in Q.op13_periodic_runs(spark, folder).na.fill(-1, ["doc_id"]).collect())
    assert [g[0] for g in got if g[0] in (1, 2, 3)] == [1, 1, 2, 3]
    want = sorted(((-1, *e[1:]) if e[0] is None else e for e in (expected(i, t) for i, t, _ in rows if i != 11)), key=lambda r: (r[0], r[-1]))
    assert [g for g in sorted(got, key=lambda r: (r[0], r[-1])) if g[0] != 11] == want
    long = next(g for g in got if g[0] == 11)
    assert long[1:6] == (1, 0, 40_000, 2, 20_000_000)
    empty = df.limit(0)
    assert P.find(empty).columns == ["doc_id", "text", "runs", "collapsed", "n_words"] and P.find(empty).count() == 0
    kept = P.find(df.withColumnRenamed("runs", "in0").withColumn("k0", df.doc_id)).where("doc_id = 12").first()
    assert kept["in0"] == "" and kept["k0"] == 12 and kept["collapsed"] == "no loop here at all"
