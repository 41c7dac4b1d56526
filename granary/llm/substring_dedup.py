"""Removal of repeated passages: every word goes that lies in a window of words found in a document of smaller id.

Windows of ``WINDOW`` words in a row that share a minimiser (the least hash among the ``GRAM``-word grams in a window)
travel as one packed string, a super-k-mer, so a word is moved about three times and not thirteen. Equal windows
have equal minimisers, hence:

1. a count of super-k-mers and the least and greatest document of each minimiser; one that is met in a single document has nothing to share;
2. super-k-mers of the other minimisers go to the bucket of their minimiser; a bucket's windows are sorted by their words
   (equal super-k-mers once), and the first document of each run of equal windows decides;
3. minimisers of more than ``HOT_ROWS`` super-k-mers never meet in a task: their windows, as hashes of 128 bits, are
   counted by sums combined before the shuffle; windows of very many places get their first document by broadcast (50,000 of them at
   most, at any size), the others by a join;
4. the stretches of each document are gathered (ids, places; no text) and taken out where the text is.

Null and empty texts, and those of fewer words than a window, lose nothing and keep their words. Rows without an id neither lose
words nor make others lose any (nothing is smaller than a null). Rows with one id are one document: they share
nothing with each other; repeated rows each get their result. Very long texts are read whole, one repeated word included.
Empty tables give no rows; other columns of any name are not carried by ``passages`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from granary.llm.columns import append_columns, bound_batches, slices, written
from granary.llm.wordgrams import joined, keyed, marked, with_lists

#: Words of a window, of a gram whose hash may be a minimiser, and windows of a super-k-mer at most.
WINDOW, GRAM, LONGEST = 13, 4, 32
#: Super-k-mers of a bucket, about, and of a minimiser beyond which its windows are counted one by one.
BUCKET_ROWS, HOT_ROWS = 20_000, 10_000
#: Bytes of texts, or of super-k-mers, that are taken at once: what comes of them is several times as much, in Python and in the JVM.
TAKEN_BYTES = 2 << 20
#: A window at more than this share of all places of hot windows is joined by broadcast.
HEAVY_SHARE = 50_000
#: An odd number, its inverse modulo 2^64, and another one, for hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE, MIX = np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64(0xD6E8FEB86659FD93)


class _Hashes:
    """64-bit hashes of the words of a text, from sums over its bytes; equal words have equal hashes anywhere."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, text: bytes, ends: np.ndarray) -> np.ndarray:
        """The hash of each word of ``text``, words parted by one space and ending at ``ends``."""
        n = len(text)
        if n > len(self.powers):
            more = 1 << n.bit_length()
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(more, x)])) for x in (BASE, INVERSE))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        starts = np.concatenate([[0], ends[:-1] + 1])
        mixed = (sums[ends] - sums[starts]) * self.inverses[starts] * MIX
        return (mixed ^ (mixed >> np.uint64(32))) * BASE


def words_of(text: str | None) -> list[bytes]:
    """Words parted by spaces and \\x09 to \\x0d only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """The minimiser of each window, from the hashes of its words."""
    n = len(hashes) - GRAM + 1
    grams = hashes[:n]
    for j in range(1, GRAM):
        grams = grams * BASE + hashes[j : n + j]
    grams = (grams ^ (grams >> np.uint64(31))) * MIX
    grams ^= grams >> np.uint64(29)
    width, least = 1, grams
    while width < WINDOW - GRAM + 1:
        step = min(width, WINDOW - GRAM + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def stretches(least: np.ndarray) -> np.ndarray:
    """Where each super-k-mer begins, among the windows: where the minimiser changes, and after LONGEST windows."""
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    places = np.arange(len(least))
    since = places - np.maximum.accumulate(np.where(fresh, places, 0))
    return np.flatnonzero(since % LONGEST == 0)


def super_kmers(rows: DataFrame, packed: bool) -> DataFrame:
    """(mini, id) for each super-k-mer of keyed rows, and with ``packed`` also its text_key, the place of its first word (at) and its words."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType([*StructType.fromDDL("mini bigint"), StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("text_key bigint, at int, packed binary" if packed else "")])
    schema = to_arrow_schema(fields)
    bound_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in (part for b in batches for part in slices(b, TAKEN_BYTES)):
            minis, of_row, places, strings = [], [], [], []
            for row, text in enumerate(batch.column(2)):
                whole = b" ".join(words_of(text.as_py()))
                ends = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 32), len(whole))
                if len(ends) < WINDOW:
                    continue
                least = minimisers(known.of(whole, ends))
                begins = stretches(least)
                minis.append((least[begins] >> np.uint64(16)).view(np.int64))  # 48 bits tell enough; equal ones are only compared
                of_row.append(np.full(len(begins), row))
                if packed:
                    places.append(begins.astype(np.int32))
                    starts = np.concatenate([[0], ends[:-1] + 1])[begins].tolist()
                    upto = ends[np.append(begins[1:], len(least)) + WINDOW - 2].tolist()
                    strings += [whole[a:b] for a, b in zip(starts, upto, strict=True)]
            if not minis:
                continue
            take = pa.array(np.concatenate(of_row))
            columns = [pa.array(np.concatenate(minis)), batch.column(0).take(take)]
            if packed:
                columns += [batch.column(1).take(take), pa.array(np.concatenate(places)), pa.array(strings, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("id", "text_key", "t").mapInArrow(run, fields)


def windows_of(packed: bytes) -> list[bytes]:
    """The windows of a super-k-mer, in order."""
    starts, at = [0], packed.find(b" ")
    while at >= 0:
        starts.append(at + 1)
        at = packed.find(b" ", at + 1)
    ends = [*starts[WINDOW:], len(packed) + 1]
    return [packed[a : b - 1] for a, b in zip(starts, ends, strict=False)]


def _share(packed: list[bytes], firsts: dict[bytes, list]) -> None:
    """Sort the windows of super-k-mers with one minimiser (or two alike in what tells them apart), given by ascending first id; the first of each run of equal windows decides."""
    places = [(p, j) for p in packed for j in range(len(firsts[p]))]
    windows = [w for p in packed for w in windows_of(p)]
    last = least = None
    for i in sorted(range(len(windows)), key=windows.__getitem__):  # stable: of equal windows the smallest id comes first
        p, j = places[i]
        if windows[i] != last:
            last, least = windows[i], firsts[p][j]
        firsts[p][j] = least


def _true_runs(flags: list[bool]) -> list[tuple[int, int]]:
    """(start, end) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.array([False, *flags, False]).astype(np.int8))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _in_bucket(schema: pa.Schema):
    """From the super-k-mers of a bucket the stretches of words that a document of smaller id holds too."""

    def run(table: pa.Table) -> pa.Table:
        minis, ids, keys, places, strings = (table.column(c).to_pylist() for c in ("mini", "id", "text_key", "at", "packed"))
        rows_of: dict[bytes, list[int]] = {}
        for row, packed in enumerate(strings):
            rows_of.setdefault(packed, []).append(row)
        least = {packed: min([ids[r] for r in rows]) for packed, rows in rows_of.items()}
        by_mini: dict[int, list[bytes]] = {}
        for packed in sorted(rows_of, key=least.__getitem__):
            by_mini.setdefault(minis[rows_of[packed][0]], []).append(packed)
        firsts = {packed: [least[packed]] * (packed.count(b" ") + 2 - WINDOW) for packed in rows_of}
        for some in by_mini.values():
            if len(some) > 1:
                _share(some, firsts)
        out: list[list] = [[], [], [], []]
        for packed, rows in rows_of.items():
            first = firsts[packed]
            alike = first.count(first[0]) == len(first)
            for row in rows:
                id, at = ids[row], places[row]
                for start, end in ([(0, len(first))] if first[0] < id else []) if alike else _true_runs([x < id for x in first]):
                    for column, value in zip(out, (id, keys[row], at + start, at + end - 1 + WINDOW), strict=True):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _exploded(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, TAKEN_BYTES)):
            rows, places, hashes = [], [], []
            for row, (at, packed) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = [xxhash.xxh3_128_digest(w) for w in windows_of(packed)]
                hashes += found
                places += range(at, at + len(found))
                rows += [row] * len(found)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())], schema=schema)

    return run


def passages(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, text_key, start, end): stretches of words, end exclusive, that a document of smaller id holds too; they may overlap."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = keyed(df, text, id).where("id is not null and octet_length(t) >= 2 * 13 - 1")
    kind = rows.schema["id"].dataType
    met = super_kmers(rows, packed=False).groupBy("mini").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    shared = written(met.where("first < last").select("mini", "n"))
    hot = shared.where(F.col("n") > HOT_ROWS)
    cold = shared.where(F.col("n") <= HOT_ROWS)
    n_cold = cold.agg(F.sum("n")).first()[0] or 0
    all_kmers = super_kmers(rows, packed=True)

    out = StructType([StructField("id", kind), *StructType.fromDDL("text_key bigint, start int, end int")])
    n_buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_cold // BUCKET_ROWS))
    bucket = F.pmod("mini", F.lit(n_buckets)).alias("bucket")
    any_hot = not hot.isEmpty()
    to_buckets = marked(cold, "mini") & ~marked(hot, "mini") if any_hot else marked(cold, "mini")
    within = F.pmod(F.shiftright("mini", 24), F.lit(1 << 15)).cast("short").alias("mini")  # in a bucket so much tells minimisers apart; two that do not are sorted together
    in_buckets = all_kmers.where(to_buckets).select(bucket, within, "id", "text_key", "at", "packed").groupBy("bucket").applyInArrow(_in_bucket(to_arrow_schema(out)), out)
    if not any_hot:
        return in_buckets
    places = StructType([StructField("id", kind), *StructType.fromDDL("text_key bigint, at int, window binary")])
    in_hot = written(all_kmers.where(marked(hot, "mini")).select("id", "text_key", "at", "packed"))  # one Python worker a task: two in a chain would hold twice as much
    windows = written(in_hot.mapInArrow(_exploded(to_arrow_schema(places)), places))
    firsts = windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").select("window", "first", "n")
    firsts = written(firsts)
    heavy = F.col("n") > F.lit(max(HOT_ROWS, windows.count() // HEAVY_SHARE))
    many, few = firsts.where(heavy).drop("n"), firsts.where(~heavy).drop("n")
    found = windows.join(F.broadcast(many), "window").unionByName(joined(windows, few, "window"))
    return in_buckets.unionByName(found.where("first < id").select("id", "text_key", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end")))


def _merger():
    def merge(gone: list) -> list[list]:
        out = []
        for spans in gone:
            packed = np.sort(np.array(spans, np.int64))
            pairs = np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1)
            upto = np.maximum.accumulate(pairs[:, 1])
            first = np.flatnonzero(np.append(True, pairs[1:, 0] > upto[:-1]))
            out.append(np.stack([pairs[first, 0], upto[np.append(first[1:], len(pairs)) - 1]], axis=1).ravel().tolist())
        return [out]

    return merge


def merged(spans: DataFrame) -> DataFrame:
    """(id, text_key, gone): the stretches of each text, those that touch as one, start and end in turn."""
    packed = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("end")  # a number, since a struct is a dict in Python
    sets = spans.groupBy("id", "text_key").agg(F.collect_set(packed).alias("spans"))
    return append_columns(sets, ["spans"], _merger, "gone array<int>").drop("spans")


def _taker():
    def take(texts: list, gone: list) -> list[list]:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts, gone, strict=True):
            words = words_of(text)
            stays = np.ones(len(words), bool)
            for start, end in zip((spans or ())[::2], (spans or ())[1::2], strict=True):
                stays[start:end] = False
            n_words.append(len(words))
            n_removed.append(len(words) - int(stays.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)] if n_removed[-1] else words).decode("utf-8", "surrogatepass"))
        return [n_words, n_removed, kept]

    return take


def without_repeats(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by a space)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    t, i = names[df.columns.index(text)], names[df.columns.index(id)]
    gone = written(merged(passages(rows, t, i)))
    keys = rows.select(*names, F.col(i).alias("id"), F.xxhash64(t).alias("text_key"))
    out = append_columns(with_lists(keys, gone, "gone"), [t, "gone"], _taker, "n_words bigint, n_removed bigint, kept string")
    taken = [n for n, c in zip(names, df.columns, strict=True) if c.lower() in ("n_words", "n_removed", "kept")]
    stay = [n for n in names if n not in taken]
    return out.select(*stay, "n_words", "n_removed", "kept").toDF(*[df.columns[names.index(n)] for n in stay], "n_words", "n_removed", "kept")
