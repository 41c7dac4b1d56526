"""Periodic runs of words: stretches that repeat themselves four times or more, found by counting equal words at each lag.

For each lag q up to a quarter of the text the words equal to the one q before are counted: those of
frequent words by one exact autocorrelation (an FFT of each word's places, the power spectra added up),
those of rare words by the differences of their places. A run of period q has 3q such matches in a row,
so only lags with that many are looked at; what runs of a divisor of q explain is subtracted first (their
matches are disjoint from those of a run whose smallest period is q). Lags that are left are probed by
hashes of the blocks between multiples of q, of which a run holds three equal ones, and where those are
met, the islands of matches are read from the words themselves. So every run that is returned, and every
lag that is passed over, rests on exact counts; hashes only say where to look.

A text is read whole within its row; work is near n·sqrt(n) for n words, memory a few times the text.

Null and empty texts have no words and no runs. Texts may be of any length. Repeated rows each get their
result, ties among runs keep the order (start, period), empty tables give no rows, other columns of any
name are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import append_columns

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Costs of one step over the differences of rare words, of one difference, of an FFT and of one of its N·log2(N) steps,
#: in ns. They part frequent words from rare ones; any values give the same counts.
STEP, PAIR, FFT, FFT_STEP = 15_000.0, 6.0, 4_000.0, 1.0
#: Values that an FFT over several words holds at once.
FFT_VALUES = 1 << 20
#: From this lag on blocks are probed by hash before the islands are read.
PROBED = 16
FIELDS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, n_words bigint"


def needed(q: np.ndarray | int) -> np.ndarray:
    """How many matches in a row a run of period ``q`` has at least."""
    return np.maximum(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)


def match_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most``, the number of places whose word is equal to the one a lag further on."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes)
    width = 1 << int(n + most - 1).bit_length()
    frequent_from = _frequent_from(sizes, width)
    heavy = np.flatnonzero(sizes >= frequent_from)
    counts = np.zeros(most + 1, np.int64)
    if len(heavy):
        power = np.zeros(width // 2 + 1)
        ends = np.cumsum(sizes)
        step = max(1, FFT_VALUES // width)
        for at in range(0, len(heavy), step):
            some = heavy[at : at + step]
            marks = np.zeros((len(some), width))
            for row, code in enumerate(some):
                marks[row, order[ends[code] - sizes[code] : ends[code]]] = 1
            spectrum = np.fft.rfft(marks, axis=1)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    places = order[(sizes[codes[order]] < frequent_from) & (sizes[codes[order]] > 1)]
    kinds = codes[places]
    left = np.arange(len(places))
    for step in range(1, len(places)):
        left = left[: np.searchsorted(left, len(places) - step)]
        left = left[kinds[left] == kinds[left + step]]
        gaps = places[left + step] - places[left]
        near = gaps <= most
        left, gaps = left[near], gaps[near]
        if not len(left):
            break
        counts += np.bincount(gaps, minlength=most + 1)
    return counts


def _frequent_from(sizes: np.ndarray, width: int) -> int:
    """The number of places from which a word is frequent, by the costs above."""
    found, words = np.unique(sizes, return_counts=True)
    tries = 2 ** np.arange(2, int(found[-1]).bit_length() + 2)
    light = found < tries[:, None]
    pairs = (light * (found.astype(float) * found / 2 * words)).sum(axis=1)
    steps = (light * found).max(axis=1)
    heavy = (~light * words).sum(axis=1)
    return int(tries[np.argmin(steps * STEP + pairs * PAIR + heavy * (FFT + FFT_STEP * width * np.log2(width)))])


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; equal numbers stand for equal words."""
    n = len(codes)
    most = n // LEAST_PERIODS
    if n < LEAST_WORDS or not most:
        return []
    lags = np.arange(most + 1)
    least = needed(lags)
    left = match_counts(codes, most)
    tries = np.flatnonzero(left >= least)
    tries = tries[tries > 0]
    if not len(tries):
        return []
    blocks = _Blocks(codes) if tries[-1] >= PROBED else None
    found: dict[tuple[int, int], int] = {}
    for q in tries.tolist():
        if left[q] < least[q] or (q >= PROBED and not blocks.may_hold(q)):
            continue
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = codes[q:] == codes[:-q]
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            whole = (start, end + q)
            if end - start < least[q] or whole in found:  # one that was found has a divisor of q for its period
                continue
            found[whole] = q
            multiples = np.arange(2 * q, min(most + 1, whole[1] - start), q)
            left[multiples] -= whole[1] - start - multiples
    return sorted((start, end - start, q) for (start, end), q in found.items())


class _Blocks:
    """Hashes of the stretches of words between multiples of a lag."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = base
        self.powers = np.cumprod(powers)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.powers[:n], out=self.sums[1:])

    def may_hold(self, q: int) -> bool:
        """Whether three blocks of ``q`` words in a row, from a multiple of ``q`` on, have equal hashes."""
        hashes = np.diff(self.sums[::q])
        equal = hashes[1:] == hashes[:-1] * self.powers[q]
        return bool((equal[1:] & equal[:-1]).any())


def _finder():
    def find(texts: list) -> list[list]:
        runs, collapsed, n_words = [], [], []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: parted by \x20 and \x09 to \x0d, and by nothing else
            known: dict[bytes, int] = {}
            codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
            found = runs_of(codes)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            if found:
                change = np.zeros(len(words) + 1, np.int64)
                for start, length, q in found:
                    change[start + q] += 1
                    change[start + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
            collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            n_words.append(len(codes))
        return [runs, collapsed, n_words]

    return find


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``runs`` (start, length and period in words, by start, then period), ``collapsed`` (the text's words but those that a run holds after its first period, joined by a space) and ``n_words``."""
    return append_columns(df, [text], _finder, FIELDS)


def greatest(runs: Column) -> Column:
    """The run of most periods, compared as fractions (ties: smallest start, then period); null where there is none."""

    def better(a: Column, b: Column) -> Column:
        return a["length"] * b["period"] > b["length"] * a["period"]

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, run: F.when(better(run, best), run).otherwise(best))


def looped(text: Column, id: Column) -> Column:
    """``text``, for one document in ten as its crc32 says, with its words from one place on going round in a loop; for a null id as it is."""
    h = F.crc32(id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    rounds = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), rounds), F.lit(1), n), " ")).otherwise(text)
