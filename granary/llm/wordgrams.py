"""Words and word grams as Column expressions: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import quoted, small

#: A word after A-Z is lowered: what is no control, punctuation or symbol of ASCII, as ranges (a negated class runs much slower).
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of at most so many rows (and columns.BROADCAST_BYTES) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Power of two of the bits in a bitmap of keys: 16 MB.
MOST_BITS = 27


def lowered(text: Column) -> Column:
    """``text`` with A-Z lowered and nothing else; where all is ASCII, by the faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def gram(tokens: Column, at: Column, k: int) -> Column:
    """The hash of the ``k`` words from the place ``at`` (from 0)."""
    return F.xxhash64(F.lit(k), *[F.get(tokens, at + j) for j in range(k)])


def keyed(df: DataFrame, text: str, id: str) -> DataFrame:
    """(id, text_key, t): an id and the hash of the text name a row; rows alike in both give one result."""
    body = F.col(quoted(text))
    return df.select(F.col(quoted(id)).alias("id"), F.xxhash64(body).alias("text_key"), body.alias("t"))


def occurrences(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, text_key, n, at, h) for each run of words of each of the sizes, from keyed rows; n are the row's words.

    Only places are exploded, and hashed from the row's words within the same generated code: no
    lambda runs for each word, and what leaves the stage are numbers, so a long text's words are never
    copied beside its places. The outer form is for the optimizer: from the inner one it infers a
    filter on the array's size, moves it below the projections and so splits the words twice. Rows
    without words give a null.
    """
    tokens = rows.select("id", "text_key", words(F.col("t")).alias("w"))
    ends, total = [], F.lit(0)
    for k in sizes:
        total = total + F.greatest(F.size("w") - (k - 1), F.lit(0))
        ends.append(total)
    places = tokens.select("id", "text_key", "w", F.explode_outer(F.when(total > 0, F.sequence(F.lit(0), total - 1))).alias("i"))
    at, h = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k, end, start in reversed(list(zip(sizes, ends, [F.lit(0), *ends], strict=False))):
        here = F.col("i") - start
        at, h = F.when(F.col("i") < end, here).otherwise(at), F.when(F.col("i") < end, gram(F.col("w"), here, k)).otherwise(h)
    return places.select("id", "text_key", F.size("w").alias("n"), at.alias("at"), h.alias("h")).where("h is not null")


def joined(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join that broadcasts ``right`` only if it is small; else only those rows of ``left`` are shuffled that a bitmap of ``right``'s keys lets through."""
    if small(right, BROADCAST_ROWS):
        return left.join(F.broadcast(right), on)
    return left.where(marked(right, on)).join(right, on)


def marked(right: DataFrame, on: str, value: Column | None = None) -> Column:
    """Whether ``value`` (the column ``on``, unless it is given) may be a key ``on`` of ``right``: a lookup in a bitmap of MOST_BITS at most, 16 a key where that is enough."""
    keys = right.select(on).distinct()
    bits = 1 << min(MOST_BITS, max(12, (16 * keys.count()).bit_length()))

    def place(key: Column) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64(key), F.lit(bits))
        return F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(F.col(on))
    set_bits = keys.groupBy(word.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    whole = right.sparkSession.range(bits >> 6).join(set_bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("one"))
    bitmap = whole.agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["bits"]).alias("bitmap")).scalar()
    word, bit = place(F.col(on) if value is None else value)
    return F.call_function("shiftright", F.get(bitmap, word.cast("int")), bit).bitwiseAND(F.lit(1)) == 1


def with_lists(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Keyed rows, left-joined with a written table (id, text_key, array ``name``).

    It is broadcast only if it is small; else a bitmap of its keys parts the rows: those that cannot have a list
    take a null where they are, and only the rest, with their texts, are shuffled.
    """
    few = lists.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), name)
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))
    if small(few, 5 * BROADCAST_ROWS):  # a list may be a few numbers; their bytes are bounded all the same
        return rows.join(F.broadcast(few), same, "left").drop("_id", "_key")
    row = F.xxhash64("id", "text_key")
    may = marked(lists.select(row.alias("_row")), "_row", row)
    return rows.where(may).join(few, same, "left").drop("_id", "_key").unionByName(rows.where(~may).withColumn(name, F.lit(None).cast(lists.schema[name].dataType)))
