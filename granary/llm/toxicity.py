"""Toxicity by classifier chains.

A chain holds one linear model a category, in order. Each sees the text's features and the
probabilities of the categories before it; in training those are out-of-fold predictions, so a later
model meets earlier ones as they are on texts they have not seen. Folds are dealt by the hash of the
text, so copies never sit on both sides. Features are whole words and word beginnings, present or not,
chosen within each fit by how far their share among positive rows stands out; a long text thus gains
nothing by its length. The threshold of the last category is the one with the best F1 out of fold at a precision of ``PRECISION``.

Labels are one flag. The categories before it are kinds of toxic rows found in the labelled texts
themselves: those rows are parted by the features in which they stand out, each going with the rows that
share most of them (spherical k-means from the two rows least alike).

The chain is fitted on a bounded sample of labelled rows that have a text: the ``most_positive`` and
``most_negative`` rows with the smallest hashes of their id, then of their text. Everything else runs over all rows: each
labelled row is scored by the models of its fold, which have not seen its text, and the threshold is
taken from the counts of both labels in narrow ranges of that score.
Null and empty texts have no features and get the base rates. Labels repeated for an id count as
positive if one is; ids without a text are ignored; without any positive label nothing is toxic. Equal
texts, so repeated rows too, get equal scores; a score on the threshold is toxic; an empty table gives no
rows; columns that bear a result's name are replaced, all others stay; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import append_columns, quoted, small, written

#: Labelled rows of either kind that a chain is fitted on.
MOST_POSITIVE, MOST_NEGATIVE = 2500, 5000
#: Kinds of toxic rows, the categories before the last, and the rounds that part them.
KINDS, ROUNDS = 2, 20
#: Out-of-fold precision that the threshold keeps where it can: clean texts are left alone.
PRECISION = 0.98
FOLDS, PREFIXES = 5, (4, 5, 6, 7)
MOST_FEATURES, LEAST_ROWS, LEAST_Z = 3000, 3, 4.0
_WORD = re.compile(r"[^\W\d_]+")
#: Width of a range of log odds in which labelled rows are counted; labels that are joined to documents before these are scored.
WIDTH, BROADCAST_ROWS = 0.01, 200_000
#: Hashed features, and words whose features a task keeps.
SPACE, _CACHE = 1 << 22, 100_000


class _Features(dict):
    """The features of a word as numbers below SPACE, by hash; kept for words seen before. ``known`` renumbers some and drops the rest."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]
        out = [xxhash.xxh64_intdigest(x) % SPACE for x in names]
        if self.known is not None:
            out = [self.known[x] for x in out if x in self.known]
        if len(self) >= _CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = tuple(out)
        return tuple(out)


def features(text: str | None, of: _Features) -> np.ndarray:
    """The distinct features of a text, sorted."""
    found: set[int] = set()
    for word in set(_WORD.findall(text.lower())) if text else ():
        found.update(of[word])
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class Linear:
    """A logistic model over present features and a few dense columns."""

    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, rows: Sequence[np.ndarray], columns: np.ndarray) -> np.ndarray:
        at, of = _present(rows, self.chosen)
        return _sigmoid(np.bincount(at, self.weights[of], len(rows)) + columns @ self.dense + self.bias)


def _present(rows: Sequence[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, index in chosen) for the chosen features of each row."""
    if not len(chosen) or not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = []
    for start in range(0, len(rows), 500):  # a few hundred texts at once: their features are many
        part = rows[start : start + 500]
        every = np.concatenate(part)
        at = np.repeat(np.arange(start, start + len(part)), [len(r) for r in part])
        of = np.minimum(np.searchsorted(chosen, every), len(chosen) - 1)
        ok = chosen[of] == every
        found.append((at[ok], of[ok]))
    return np.concatenate([a for a, _ in found]), np.concatenate([o for _, o in found])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose(rows: Sequence[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features whose share among positive rows stands out most, at least by LEAST_Z standard deviations, and the log of how far."""
    n_pos, n_rest = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    if not rows:
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    positive, rest = np.zeros(SPACE, dtype=np.int32), np.zeros(SPACE, dtype=np.int32)
    for r, label in zip(rows, y, strict=True):  # a row's features are distinct
        (positive if label else rest)[r] += 1
    found = np.flatnonzero(positive >= LEAST_ROWS)
    positive, rest = positive[found], rest[found]
    expected = rest / n_rest * n_pos
    z = (positive - expected) / np.sqrt(expected + 0.5)
    ratio = np.log((positive + 0.5) / n_pos * n_rest / (rest + 0.5))
    sure = z >= LEAST_Z
    found, z, ratio = found[sure].astype(np.int32), z[sure], ratio[sure]
    # of features that stand in just the same rows (a word and its beginnings), one is enough
    at, of = _present(rows, found)
    marks = np.bincount(of, np.random.default_rng(1).random(len(rows))[at], len(found))
    _, first = np.unique(np.round(marks, 9), return_index=True)
    best = np.sort(first[np.argsort(-z[first], kind="stable")[:MOST_FEATURES]])
    return found[best], ratio[best]


def fit_linear(rows: Sequence[np.ndarray], columns: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 1.0, penalty: float = 0.1) -> Linear:
    chosen, scale = choose(rows, y)  # a feature counts by the log of its ratio, so rare but sure ones are learned as fast as others
    at, of = _present(rows, chosen)
    n, k, d = len(rows), len(chosen), columns.shape[1]
    if not n:
        return Linear(dense=np.zeros(d))
    rate0 = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(k + d + 1)
    w[-1] = np.log(rate0 / (1 - rate0))
    seen = np.full(k + d + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(at, (w[:k] * scale)[of], n) + columns @ w[k : k + d] + w[-1]
        gap = (_sigmoid(score) - y) / n
        g = np.r_[np.bincount(of, gap[at], k) * scale, columns.T @ gap, gap.sum()]
        g[:-1] += penalty / n * w[:-1]
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return Linear(chosen, w[:k] * scale, w[k : k + d], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    threshold: float
    held_out_f1: float = 0.0
    held: list[list[Linear]] = field(default_factory=list)  # for each fold, the models fitted on the others

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        words = _Features()
        rows = [features(t, words) for t in texts]
        out = np.zeros((len(rows), 0))
        for m in self.models:
            out = np.c_[out, m.score(rows, out)]
        return out


def _fold(text: str | None, folds: int) -> int:
    return xxhash.xxh64_intdigest((text or "").encode(), 7) % folds


def fit_chain(rows: Sequence[np.ndarray], fold: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """A chain over ``labels`` (category: 0/1 a row, in order) of rows of features, each of a fold; the last category's threshold is set out of fold."""
    unseen = np.zeros((len(rows), 0))
    models, outside = [], [[] for _ in range(folds)]
    for y in labels.values():
        models.append(fit_linear(rows, unseen, y))
        held = np.zeros(len(rows))
        for f in range(folds):
            inside, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m = fit_linear([rows[i] for i in inside], unseen[inside], y[inside])
            outside[f].append(m)
            if len(out):
                held[out] = m.score([rows[i] for i in out], unseen[out])
        unseen = np.c_[unseen, held]
    truth = list(labels.values())[-1]
    threshold, best = calibrate(unseen[:, -1], truth)
    return Chain(list(labels), models, threshold, best, outside)


def calibrate(p: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, least: float = 0.0) -> tuple[float, float]:
    """The threshold with the best F1 among those of precision PRECISION, or else of all, midway to the next lower score (``least`` below all); over all scores if there is no positive row. ``rows`` are the rows of each score and ``y`` the positive ones, one row a score if not given."""
    if not y.sum():
        return 2.0, 0.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    n = np.arange(1, len(p) + 1) if rows is None else np.cumsum(rows[order])
    f1 = 2 * hit / (n + y.sum())
    ends = np.r_[np.diff(p[order]) != 0, True]
    sure = ends & (hit >= PRECISION * n)
    at = int(np.argmax(np.where(sure if sure.any() else ends, f1, -1)))
    below = p[order][at + 1] if at + 1 < len(p) else least
    return float((p[order][at] + below) / 2), float(f1[at])


def _labels(labels: DataFrame, id: str, label: str) -> DataFrame:
    """(_id, y): one row a labelled id."""
    return labels.where(F.col(quoted(label)).isNotNull() & F.col(quoted(id)).isNotNull()).groupBy(F.col(quoted(id)).alias("_id")).agg(F.max(label).cast("int").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, most_positive: int, most_negative: int) -> DataFrame:
    """(t, y): the texts of the bounded sample of labelled rows. Ids are sampled among those that have a text; where ids repeat, the bound holds for rows too."""
    return _sample(docs, written(_labels(labels, id, label)), text, id, most_positive, most_negative)


def _sample(docs: DataFrame, each: DataFrame, text: str, id: str, most_positive: int, most_negative: int) -> DataFrame:
    texts = docs.select(F.col(quoted(id)).alias("_id"), F.col(quoted(text)).alias("t")).where("t is not null")
    # one pass over the ids; what is asked of them twice is written
    known = written(texts.select("_id").join(F.broadcast(each) if small(each, BROADCAST_ROWS) else each, "_id").distinct())
    most = {1: most_positive, 0: most_negative}
    first = [F.xxhash64("_id"), "_id"]
    ids = [known.where(F.col("y") == y).orderBy(*first).limit(n) for y, n in most.items()]
    rows = written(texts.join(F.broadcast(ids[0].unionByName(ids[1])), "_id"))  # bounded by the sample
    got = [rows.where(F.col("y") == y).orderBy(*first, F.xxhash64("t"), "t").limit(n).select("t", "y") for y, n in most.items()]
    return got[0].unionByName(got[1])


def kinds(rows: Sequence[np.ndarray], y: np.ndarray, n: int = KINDS, rounds: int = ROUNDS) -> np.ndarray:
    """One row of 0/1 a kind: the positive rows parted by the features in which they stand out. Every positive row is of one kind; ties go to the first."""
    out = np.zeros((n, len(rows)))
    chosen, weight = choose(rows, y)
    positive = np.flatnonzero(y)
    if not len(positive):
        return out
    x = np.zeros((len(positive), len(chosen)), dtype=np.float32)  # as many rows as the sample has positive ones, at most
    at, of = _present([rows[i] for i in positive], chosen)
    x[at, of] = weight[of]
    # a feature that nearly all of them share does not part them
    share = (x > 0).mean(axis=0)
    x *= np.where(share > 0, np.log(1 / np.maximum(share, 1e-9)), 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    middle = x.sum(axis=0)
    centres = [x[int(np.argmin(x @ middle))]]
    while len(centres) < n:
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        c = np.array([x[of == k].sum(axis=0) if (of == k).any() else c[k] for k in range(n)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    out[np.argmax(x @ c.T, axis=1), positive] = 1.0
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", n_kinds: int = KINDS, most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE) -> Chain:
    each = written(_labels(labels, id, label))
    got = _sample(docs, each, text, id, most_positive, most_negative).toPandas().sort_values(["t", "y"])
    y, words = got["y"].to_numpy(dtype=float), _Features()
    rows = [features(t, words) for t in got["t"]]
    fold = np.array([_fold(t, FOLDS) for t in got["t"]], dtype=np.int64)
    del got, words  # the texts themselves are not needed any more
    chain = {f"kind{i + 1}": of for i, of in enumerate(kinds(rows, y, n_kinds))}
    out = fit_chain(rows, fold, chain | {label: y})
    del rows
    out.threshold, out.held_out_f1 = threshold(docs, each, out, text, id)
    return out


def threshold(docs: DataFrame, each: DataFrame, chain: Chain, text: str, id: str) -> tuple[float, float]:
    """The threshold of the last category and its F1, by the out-of-fold scores of all labelled rows; ``each``: (_id, y), written."""
    each = each.where("y in (0, 1)")
    rows = docs.select(F.col(quoted(id)).alias("_id"), F.col(quoted(text)).alias("t")).where("t is not null and _id is not null")
    if small(each, BROADCAST_ROWS):
        scored = _ranges(rows.join(F.broadcast(each), "_id"), chain)
    else:  # texts are not shuffled: all are scored, and their ranges joined
        scored = _ranges(rows, chain).join(each, "_id")
    counts = scored.groupBy("range").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).toPandas()
    if not counts["hits"].sum():
        return 2.0, 0.0
    at = counts["range"].to_numpy(dtype=float)
    odds, f1 = calibrate(at + 0.5, counts["hits"].to_numpy(dtype=float), counts["n"].to_numpy(dtype=float), at.min() - 0.5)
    return float(_sigmoid(odds * WIDTH)), f1


def _ranges(rows: DataFrame, chain: Chain) -> DataFrame:
    """``rows`` with the range of the log odds that the models of the other folds give to ``t``, in place of ``t``."""
    names, tables = _tables([m for models in chain.held for m in models])
    folds, depth = len(chain.held), len(chain.models)
    steps = [[(tables[f * depth + k], m.dense, m.bias) for k, m in enumerate(models)] for f, models in enumerate(chain.held)]

    def make():
        words = _Features(names)

        def run(texts):
            fold, out = np.array([_fold(t, folds) for t in texts]), np.zeros(len(texts), dtype=np.int64)
            for f in set(fold.tolist()):
                of = np.flatnonzero(fold == f)
                p = _scores([features(texts[i], words) for i in of], steps[f])[:, -1]
                out[of] = np.floor(np.log(p / (1 - p)) / WIDTH)
            return [out.tolist()]

        return run

    return append_columns(rows, ["t"], make, "range bigint").drop("t")


def _tables(models: Sequence[Linear]) -> tuple[dict[int, int], list[np.ndarray]]:
    """Numbers for the features of all models, and the weights of each model by number."""
    known = np.unique(np.concatenate([m.chosen for m in models]))
    tables = [np.zeros(len(known) + 1) for _ in models]
    for t, m in zip(tables, models, strict=True):
        t[np.searchsorted(known, m.chosen)] = m.weights
    return {int(f): i for i, f in enumerate(known)}, tables


def _scores(rows: Sequence[np.ndarray], steps: Sequence[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """The probabilities of a chain's categories, by the (weights, dense weights, bias) of each."""
    p = np.zeros((len(rows), 0))
    for t, d, b in steps:
        p = np.c_[p, _sigmoid(np.array([t[r].sum() for r in rows]) + p @ d + b)]
    return p


def classify(df: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_", to: str = "is_toxic") -> DataFrame:
    """``df`` with the probability of each category and whether the last one reaches the chain's threshold."""
    names, tables = _tables(chain.models)
    steps, limit = [(t, m.dense, m.bias) for t, m in zip(tables, chain.models, strict=True)], chain.threshold

    def make():
        words = _Features(names)

        def run(texts):
            p = _scores([features(t, words) for t in texts], steps)
            return [*p.T.tolist(), (p[:, -1] >= limit).tolist()]

        return run

    return append_columns(df, [text], make, ", ".join(f"`{prefix}{c}` double" for c in chain.categories) + f", {to} boolean")
