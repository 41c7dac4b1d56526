"""SimHash near-duplicates: fingerprints linked by pigeonring filtering, and their components.

A fingerprint has 64 bits over the XXH64 values of a text's word shingles. Two link when they differ
in at most ``distance`` bits. With the bits cut into ``segments`` on a ring, a linked pair has a
segment from which *every* chain of consecutive segments keeps within its share of the distance: after
l segments at most floor(l * distance / segments) bits differ. From that follow the keys: the first
segments of a chain must be equal, and of the next ones, among which one bit may differ, all but one
are equal. Every distinct fingerprint goes out under one key a start and segment left out; those that
meet under a key are compared chain by chain, most fall out early, the rest get the full check.

Exact copies are one fingerprint before anything is compared. A key's group is compared in one task up
to ``GROUP`` members, and gives a spanning forest of its links, never all pairs. Keys of more members
are found by a count that combines before the shuffle, and never meet in a task: their members go out
under every value within half the distance of theirs, and those that meet under a value are linked to
its least. Any two fingerprints within the distance share such a value, and a value has a bounded number
of them, so this is exact, and linear in the members where blocks of pairs would be quadratic.
Components come from large-star and small-star rounds over written tables; nothing of it passes through
the driver. Fingerprints with very many copies get their component by broadcast, so no copies meet in
one task either.

Null and empty texts have fingerprint zero and link like any other; equal texts tie and share all. Rows
with a null id get the component of their fingerprint, whose id is the smallest that is not null (null if
there is none). Repeated rows each get their result; an empty table gives no rows; other columns are not
carried by ``near_duplicates``, and any name will do for ``keep_one``. Very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import append_columns, quoted, written
from granary.llm.columns import small as is_small

BITS, BROADCAST_KEYS = 64, 500_000
#: Members of a key's group that one task compares with each other.
GROUP = 4096
#: A fingerprint is handed to its rows by broadcast if it has over HOT_ROWS of them and over 1/HOT_SHARE of all; so at most HOT_SHARE are.
HOT_ROWS, HOT_SHARE = 1000, 200_000
#: Up to so many members, the pairs of all groups are compared at once, by their offset.
SMALL = 32
_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a whole text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(" ".join(words), seed)]
    else:
        hashes = [digest(s, seed) for s in map(" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))]
    n = len(hashes)
    values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(values[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def add_fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, to: str = "simhash") -> DataFrame:
    """``df`` with the fingerprint of each text as a signed 64-bit integer."""

    def make():
        def run(texts):
            return [[f - (1 << 64) if f >> 63 else f for f in (fingerprint(t, shingle, seed) for t in texts)]]

        return run

    return append_columns(df, [text], make, f"{to} bigint")


class Ring:
    """Segments, the budget of a chain of each length, and the keys that a start gives."""

    def __init__(self, segments: int = 16, distance: int = 4):
        if not 0 <= distance < segments <= 32:
            raise ValueError("there must be more segments than bits that may differ, and 32 at most")
        self.m, self.distance = segments, distance
        cuts = [BITS * i // segments for i in range(segments + 1)]
        self.masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << (BITS - cuts[i + 1]) for i in range(segments)]
        self.budget = [length * distance // segments for length in range(segments + 1)]
        equal = max(k for k in range(1, segments + 1) if self.budget[k] == 0)
        upto = max(k for k in range(1, segments + 1) if self.budget[k] <= 1)
        self.keys: list[tuple[int, int]] = []  # the start, and the mask of bits that must be equal
        for i in range(segments):
            chain = [self.masks[(i + j) % segments] for j in range(upto)]
            for left_out in range(equal, upto) if upto > equal else [None]:
                self.keys.append((i, sum(x for j, x in enumerate(chain) if j != left_out)))

    def passes(self, differ: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The places in ``differ`` (XOR of two fingerprints) where all chains from ``start``, then the whole, keep within budget."""
        masks = np.array(self.masks, dtype=np.uint64)
        at = np.arange(len(differ))
        so_far = np.zeros(len(differ), dtype=np.uint8)
        for length in range(1, self.m + 1):
            so_far += np.bitwise_count(differ & masks[(start + length - 1) % self.m])
            ok = so_far <= self.budget[length]
            if not ok.all():
                at, so_far, differ, start = at[ok], so_far[ok], differ[ok], start[ok]
            if not len(at):
                break
        return at[np.bitwise_count(differ) <= self.distance]


def _forest(ring: Ring, members: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a group that keep its linked members together."""
    edges = []
    waiting = members.copy()
    while len(waiting) > 1:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            near = ring.passes(waiting ^ x, np.full(len(waiting), start))
            if len(near):
                found = waiting[near]
                edges.append((np.full(len(found), x), found))
                queue.extend(found)
                waiting = np.delete(waiting, near)
    return edges


def _as_links(edges: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if edges:
        a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in zip(*edges, strict=True))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def _group_runs(ring: Ring, few: int):
    """For batches sorted by key: the links within each key's group."""
    starts = np.array([i for i, _ in ring.keys])

    def of(keys: np.ndarray) -> np.ndarray:
        return starts[keys >> 56]

    def groups(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.r_[first, len(keys)])
        edges = []
        small = (length > 1) & (length <= few)
        where, many = first[small], length[small]
        for gap in range(1, int(many.max(initial=0))):
            ok = many > gap
            where, many = where[ok], many[ok]
            total = int((many - gap).sum())
            one = np.repeat(where - np.r_[0, np.cumsum(many - gap)[:-1]], many - gap) + np.arange(total)
            near = ring.passes(prints[one] ^ prints[one + gap], of(keys[one]))
            if len(near):
                edges.append((prints[one[near]], prints[one[near] + gap]))
        for i in np.flatnonzero(length > few):
            edges += _forest(ring, prints[first[i] : first[i] + length[i]], int(of(keys[first[i]])))
        yield from _as_links(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys, prints = np.r_[keys, batch.column(0).to_numpy()], np.r_[prints, batch.column(1).to_numpy().view(np.uint64)]
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            if last:
                yield from groups(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
        if len(keys):
            yield from groups(keys, prints)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(prints: DataFrame, ring: Ring) -> DataFrame:
    """A row (key, fingerprint) for each key of each fingerprint; a key's top byte tells which mask it is of."""
    value = F.col("simhash")
    keys = [F.xxhash64(value.bitwiseAND(F.lit(_signed(mask)))).bitwiseAND(F.lit((1 << 56) - 1)).bitwiseOR(F.lit(_signed(j << 56))) for j, (_, mask) in enumerate(ring.keys)]
    if len(keys) > 127:
        raise ValueError("so many segments give too many keys")
    return prints.select(F.explode(F.array(*keys)).alias("key"), value)


def links(prints: DataFrame, segments: int = 16, distance: int = 4, group: int = GROUP, small: int = SMALL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``simhash``) that join all that are linked."""
    ring = Ring(segments, distance)
    rows = keyed(prints, ring)
    large = written(rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > group).select("key"))
    if large.isEmpty():
        hot = None
    else:
        table = F.broadcast(large) if is_small(large, BROADCAST_KEYS) else large
        hot = written(rows.join(table, "key", "left_semi").select("simhash").distinct())
        rows = rows.join(table, "key", "left_anti")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    out = dealt.mapInArrow(_group_runs(ring, small), "a bigint, b bigint")
    return out if hot is None else out.unionByName(near_links(hot, distance))


def near_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that join all of ``prints`` within the distance, by the values that they share.

    Of two fingerprints within the distance, one has a value in the middle within half of it, rounded
    down, the other within half of it, rounded up. So all who meet at a value are linked to the least of
    those within the smaller half: no further than the distance from any of them.
    """
    least, most = distance // 2, (distance + 1) // 2
    flips = [(_signed(sum(1 << b for b in bits)), n <= least) for n in range(most + 1) for bits in combinations(range(BITS), n)]
    masks = lambda near: F.lit([m for m, x in flips if x == near]).cast("array<bigint>")
    at = lambda near: F.transform(masks(near), lambda m: F.struct(F.col("simhash").bitwiseXOR(m).alias("value"), F.lit(near).alias("near")))
    every = at(True) if least == most else F.concat(at(True), at(False))
    met = prints.select("simhash", F.inline(every)).groupBy("value").agg(F.min(F.when(F.col("near"), F.col("simhash"))).alias("a"), F.collect_set("simhash").alias("members"))  # no more of them than flips
    return met.where(F.col("a").isNotNull() & (F.size("members") > 1)).select("a", F.explode("members").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest member of each node's component: rows (node, root), one for each node of ``edges`` (a, b).

    Large-star and small-star rounds until the edges stay as they are. Minima are combined before the
    shuffle, and a node with very many edges meets its minimum in a join that Spark can split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sums = None
    while True:
        again = _mark(now)
        if again == sums or not again[0]:
            break
        sums = again
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each u now links to smaller v only
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        hung = star.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _classes(df: DataFrame, text: str, id: str, shingle: int, seed: int, segments: int, distance: int, limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, simhash) of each row, and (simhash, component_id, n) of each fingerprint, n being its rows."""
    body = F.col(quoted(text))
    given = df.select(F.col(quoted(id)).alias("id"), F.xxhash64(body).alias("text_key"), body.alias("t"))
    prints = written(add_fingerprints(given, "t", shingle, seed).select("id", "text_key", "simhash"))
    classes = written(prints.groupBy("simhash").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    found = written(components(links(classes.select("simhash"), segments, distance, **limits)))
    member = classes.join(found, classes.simhash == found.node)
    root = member.groupBy("root").agg(F.min("least").alias("least"))
    wider = found.join(root, "root").select(F.col("node").alias("simhash"), F.col("least").alias("component"))
    return prints, written(classes.join(wider, "simhash", "left").select("simhash", F.coalesce("component", "least").alias("component_id"), "n"))


def _labelled(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """``prints`` with component_id. Fingerprints with very many rows are broadcast (HOT_SHARE of them at most), the others joined by shuffle."""
    rows = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.col("n") > max(HOT_ROWS, rows // HOT_SHARE)
    hot, cold = classes.where(many).select("simhash", "component_id"), classes.where(~many).select("simhash", "component_id")
    return prints.join(F.broadcast(hot), "simhash").unionByName(prints.join(F.broadcast(hot.select("simhash")), "simhash", "left_anti").join(cold, "simhash"))


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 4, seed: int = 42, segments: int = 16, distance: int = 4, **limits: int) -> DataFrame:
    """Per row of ``df``: its id, ``simhash`` (a signed 64-bit integer) and ``component_id``, the smallest id among all rows that links reach."""
    prints, classes = _classes(df, text, id, shingle, seed, segments, distance, limits)
    return _labelled(prints, classes).select(F.col("id").alias(id), "simhash", "component_id")


def keep_one(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 4, seed: int = 42, segments: int = 16, distance: int = 4, **limits: int) -> DataFrame:
    """The rows of ``df`` whose id is their component's: one document of each group of near-duplicates.

    Rows that repeat both id and text count once, by their other columns; rows that share an id but not
    the text are kept apart unless they link to a smaller id. Rows with a null id cannot stand for a
    group: all stay.
    """
    prints, classes = _classes(df, text, id, shingle, seed, segments, distance, limits)
    kept = written(_labelled(prints, classes).where("id = component_id").groupBy("id", "text_key").agg(F.count("*").alias("n")))
    names = [f"c{i}" for i in range(len(df.columns))]
    given = df.toDF(*names).withColumn("k0", F.col(names[df.columns.index(id)])).withColumn("k1", F.xxhash64(F.col(names[df.columns.index(text)])))
    mine = lambda n: kept.where(n).select(F.col("id").alias("k0"), F.col("text_key").alias("k1"))
    once = given.join(mine("n = 1"), ["k0", "k1"], "left_semi").select(*names)
    rest = [F.col(c) for c, (old, kind) in zip(names, df.dtypes, strict=True) if old not in (id, text) and "map<" not in kind and kind != "variant"]
    # rows alike are combined before the shuffle, however many there are
    several = given.join(mine("n > 1"), ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.min_by(F.struct(*names), F.xxhash64(F.lit(0), *rest)).alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in names])
    return once.unionByName(several).toDF(*df.columns).unionByName(df.where(F.col(quoted(id)).isNull()))
