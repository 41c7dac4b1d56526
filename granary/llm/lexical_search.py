"""Ranked lexical search: postings in shards of documents, with integer impacts computed beforehand.

``build`` deals the rows of a table into shards (as many documents as lie in one task up to a number of
terms) and writes one row a shard: its document ids in ascending order, its terms, and in CSR form each
term's documents and their impacts (10^9·tf div (1000·tf + 8·m), m from the document's and the average
length). ``search`` packs queries into blocks, sends each shard only the postings of terms that a block
asks for, and adds them up term by term into one dense integer accumulator a query; argpartition finds
the k best, equal scores at the edge are taken in the order of ids. Each task keeps its k best a query over all
its shards, and only those are shuffled and ranked.

Nothing of the corpus goes through the driver but two sums. Queries are broadcast where they are of a
checked size, else blocks meet shards by a shuffle. Every document is indexed and no term is left out; a shard
is bounded by its number of terms (but for a single longer document).

Null and empty texts, and those without a term, are in no posting and do not count as documents; queries without a
term that occurs give no rows. Rows with one id are documents each; of equal scores those with a null id come last.
Repeated query rows each get their result. Very long texts are read whole. Empty tables give no rows. Other
columns of any name are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from granary.llm.columns import bound_batches, quoted, small, written
from granary.llm.wordgrams import BROADCAST_ROWS, joined, words

#: Terms (with repeats) and documents of a shard.
SHARD_TERMS, SHARD_DOCS = 1 << 19, 1 << 15
#: Different terms of the queries in a block, about.
BLOCK_TERMS = 1 << 17
#: Bytes of a row group of shards: what a task reads at once.
GROUP_BYTES = 16 << 20
#: Queries whose best documents a task keeps before it hands them on.
KEPT_QUERIES = 1 << 16
#: A byte of a term stands for itself, A-Z for a-z; what parts terms becomes a space. Bytes from 0x80 on are of letters beyond ASCII.
BYTES = bytes((c if chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32) if c < 128 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: maximal runs of ASCII letters, digits and anything beyond ASCII, with only A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


@dataclass(frozen=True)
class Index:
    """A written table of shards, the number of documents that have a term, and that of all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms_of(text.as_py()))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self):
        self.ids, self.lengths, self.codes, self.known = [], [], [], {}

    def add(self, id, terms: list[bytes]) -> None:
        known = self.known
        self.ids.append(id)
        self.lengths.append(len(terms))
        self.codes.extend([known.setdefault(t, len(known)) for t in terms])

    def row(self, n_docs: int, n_terms: int, schema: pa.Schema) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (True,) if self.ids[i] is None else (False, self.ids[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = np.fromiter(self.codes, np.int64, len(self.codes))
        pairs, tf = np.unique(codes * len(order) + np.repeat(place, self.lengths), return_counts=True)
        codes, docs = np.divmod(pairs, len(order))
        m = np.array([10 + 90 * n * n_docs // n_terms for n in self.lengths], np.int64)[order]
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        dfs = np.bincount(codes, minlength=len(self.known))
        row = [[self.ids[i] for i in order]], [[t.decode("utf-8", "surrogatepass") for t in self.known]], [dfs.tolist()], [docs.astype("<i4").tobytes()], [impacts.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def build(df: DataFrame, text: str = "text", id: str = "doc_id") -> Index:
    """The index of every row of ``df``, written to the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df)
    rows = df.select(F.col(quoted(text)).alias("t"), F.col(quoted(id)).alias("id")).where("octet_length(t) > 0")
    sums = rows.select("t").mapInArrow(_count, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0
    schema = StructType([StructField("ids", ArrayType(rows.schema["id"].dataType)), *StructType.fromDDL("terms array<string>, dfs array<int>, docs binary, impacts binary")])
    as_arrow = to_arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for t, i in zip(batch.column(0), batch.column(1), strict=True):
                if terms := terms_of(t.as_py()):
                    if shard.ids and (len(shard.codes) + len(terms) > SHARD_TERMS or len(shard.ids) >= SHARD_DOCS):
                        yield shard.row(n_docs, n_terms, as_arrow)
                        shard = _Shard()
                    shard.add(i.as_py(), terms)
        if shard.ids:
            yield shard.row(n_docs, n_terms, as_arrow)

    bounds = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 2, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.min": 1}
    return Index(written(rows.mapInArrow(deal, schema), **bounds), n_docs, n_terms)


def weights(index: Index, asked: DataFrame) -> DataFrame:
    """(term, w) for each term of the table ``asked`` that occurs: floor(1000·ln((2N + 2) / (2·df + 1)))."""
    held = index.shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("n"))
    df = joined(held, written(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.floor(F.lit(1000) * F.log(F.lit(2.0 * index.n_docs + 2) / (F.col("df") * 2 + 1))).alias("w"))


def _blocks(index: Index, queries: DataFrame) -> DataFrame:
    """Written rows (block, queries): each query's number and its terms, as places in the block's list ``terms`` with weights ``ws``."""
    asked = written(queries.select("q", F.explode(F.array_distinct(words(F.col("t")))).alias("term")))
    weighted = written(joined(asked, written(weights(index, asked)), "term"))
    n = max(1, -(-weighted.count() // BLOCK_TERMS))
    by_query = weighted.groupBy("q").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    return written(by_query.groupBy(F.pmod(F.xxhash64("q"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("q", "terms", "ws")).alias("queries")))


class _Block:
    """Queries of a block: for each of its terms a place, and each query's places and weights."""

    def __init__(self, queries: list[dict]):
        places: dict[str, int] = {}
        self.queries = [(x["q"], [(places.setdefault(t, len(places)), w) for t, w in zip(x["terms"], x["ws"], strict=True)]) for x in queries]
        self.terms = pa.array(list(places), pa.string())

    def scores(self, terms: pa.Array, dfs: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """The accumulators of each query that a shard of ``n`` documents holds a term of."""
        asked = pc.index_in(terms, value_set=self.terms)
        rows = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
        ends = np.cumsum(dfs)
        postings = [None] * len(self.terms)
        for row, place in zip(rows.tolist(), asked.drop_null().to_pylist(), strict=True):
            postings[place] = docs[ends[row] - dfs[row] : ends[row]], impacts[ends[row] - dfs[row] : ends[row]]
        for q, parts in self.queries:
            found = [(w, postings[place]) for place, w in parts if w and postings[place] is not None]
            if found:
                sums = np.zeros(n, np.int64)
                for w, (at, impact) in found:
                    sums[at] += w * impact
                yield q, sums


def best(sums: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest sums above 0, equal ones at the edge from the front."""
    if len(sums) > k:
        edge = max(1, int(sums[np.argpartition(sums, len(sums) - k)[len(sums) - k :]].min()))
        above = np.flatnonzero(sums > edge)
        return np.concatenate([above, np.flatnonzero(sums == edge)[: k - len(above)]])
    return np.flatnonzero(sums > 0)


def search(index: Index, queries: DataFrame, k: int = 10, text: str = "text", id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """(``id``, rank, ``doc_id``, score): the ``k`` highest-scoring documents of each row of ``queries``, equal scores by ascending document id."""
    numbered = written(queries.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("t")).withColumn("q", F.monotonically_increasing_id()))
    blocks = _blocks(index, numbered)
    n_blocks = blocks.count()
    pairs = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_blocks) - 1))))
    pairs = pairs.join(F.broadcast(blocks) if small(blocks, BROADCAST_ROWS) else blocks, "block").select("block", "queries", "ids", "terms", "dfs", "docs", "impacts")
    schema = StructType([*StructType.fromDDL("q bigint, score bigint"), StructField("doc", index.shards.schema["ids"].dataType.elementType)])

    from pyspark.sql.pandas.types import to_arrow_schema

    as_arrow = to_arrow_schema(schema)

    def handed(kept: dict[int, list]) -> pa.RecordBatch:
        rows = [(q, -score, doc[0] if doc else None) for q, top in kept.items() for score, _, *doc in top]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(as_arrow)], schema=as_arrow)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        number, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(names[name])[i]  # noqa: B023, E731
                if number != get("block").as_py():
                    number, block = get("block").as_py(), _Block(get("queries").as_py())
                ids, (docs, impacts) = get("ids").values, (np.frombuffer(get(x).as_py(), "<i4") for x in ("docs", "impacts"))
                for q, sums in block.scores(get("terms").values, get("dfs").values.to_numpy().astype(np.int64), docs, impacts.astype(np.int64), len(ids)):
                    top = kept.setdefault(q, [])
                    if len(top) == k:  # what is below the k-th so far cannot come in
                        sums[sums < -top[-1][0]] = 0
                    places = best(sums, k)
                    if len(places):
                        new = [(-int(s), d is None, *(() if d is None else (d,))) for s, d in zip(sums[places], ids.take(pa.array(places)).to_pylist(), strict=True)]
                        kept[q] = sorted(top + new)[:k]
                if len(kept) > KEPT_QUERIES:
                    yield handed(kept)
                    kept = {}
        if kept:
            yield handed(kept)

    names = {c: i for i, c in enumerate(pairs.columns)}
    ranked = pairs.mapInArrow(rank, schema).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc")))).where(F.col("rank") <= k)
    return _named(ranked, numbered).select(F.col("id").alias(id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")


def _named(ranked: DataFrame, numbered: DataFrame) -> DataFrame:
    names = numbered.select("q", "id")
    return ranked.join(F.broadcast(names) if small(names, BROADCAST_ROWS) else names, "q")
