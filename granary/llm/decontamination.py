"""Benchmark decontamination: an exact containment join over item-sized windows, by prefix filtering.

A window is a run of ``size`` words of an item (the whole item if it is shorter). A document holds a
window only if it holds every shingle of it, so one necessary shingle, the rarest over all documents,
is enough to look for: with containment 1 the prefix of the window's shingles, ordered by rarity, has
length one. Windows whose rarest shingle is the same place of the item share a row: the stretch of
the item that they cover and the place of the shingle in it. A document's shingles meet those rows by
hash; the place in the document bounds what can fit on either side, and the words themselves decide:
the run of equal words about the shingle is a hit if it is as long as a window. Windows with a
shingle that no document has are dropped before the join.

Built-in functions only. Null and empty texts have no words; items without words have no windows;
items with a null id mark words but are not listed. Items that tie (equal texts) are all listed;
repeated rows each get their result; empty tables give no rows, or no hits; other columns of any name
are kept by ``without_contaminated`` and not carried by ``contamination``. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import quoted, small, written
from granary.llm.wordgrams import BROADCAST_ROWS, gram, joined, keyed, occurrences, with_lists, words

#: Words of a window, and of the shingles by which windows are found.
WINDOW, SHINGLE = 10, 3


def item_words(items: DataFrame, text: str = "text", id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(item_id, item_key, item, size): the words of each item that has some, a key of its id and text, and the size of its windows."""
    whole = items.select(F.col(quoted(id)).alias("item_id"), F.xxhash64(F.col(quoted(id)), F.col(quoted(text))).alias("item_key"), words(F.col(quoted(text))).alias("item")).where(F.size("item") > 0)
    return whole.withColumn("size", F.least(F.lit(window), F.size("item")))


def item_windows(items: DataFrame, text: str = "text", id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row (item_key, size, start, at, k, h) for each shingle of each window of each item: numbers only, so a long item's words stand beside none of its places."""
    sized = item_words(items, text, id, window).withColumn("k", F.least(F.lit(shingle), F.col("size")))
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("item") - F.col("size"))))
    places = starts.withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - F.col("k"))))
    h = F.lit(None).cast("bigint")
    for k in range(1, shingle + 1):
        h = F.when(F.col("k") == k, gram(F.col("item"), F.col("at"), k)).otherwise(h)
    return places.select("item_key", "size", "start", "at", "k", h.alias("h"))


def _equal_run(tokens: Column, stretch: Column, begin: Column, place: Column) -> tuple[Column, Column]:
    """How many words are equal just before ``place`` of the stretch, and from it on; ``begin`` is the stretch's start in the tokens."""
    same = F.transform(stretch, lambda word, j: F.coalesce(F.when(begin + j >= 0, F.get(tokens, begin + j)) == word, F.lit(False)))
    left = F.array_position(F.reverse(F.slice(same, F.lit(1), place)), False)
    right = F.array_position(F.slice(same, place + 1, F.size(same)), False)
    return (F.when(left == 0, place).otherwise(left - 1).cast("int"), F.when(right == 0, F.size(stretch) - place).otherwise(right - 1).cast("int"))


def candidates(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, met): for each document the stretches of items that it may hold and the places where they would begin, by the hash of the stretch's rarest shingle."""
    places = written(item_windows(items, item_text, item_id, window, shingle))
    sizes = sorted(r[0] for r in places.select("k").distinct().collect()) or [shingle]
    found = occurrences(keyed(docs, text, id), sizes)
    seen = written(joined(found, places.select("h").distinct(), "h"))
    counts = seen.groupBy("h").agg(F.count("*").alias("n"))
    counted = places.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("item_key", "size", "k", "start").agg(F.min(F.struct("n", "h", "at")).alias("rare")).where("rare.n > 0")
    shared = rarest.groupBy("item_key", "size", F.col("rare.h").alias("h"), F.col("rare.at").alias("at")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    of_item = shared.groupBy("item_key", "size").agg(F.collect_list(F.struct("h", "at", "lo", "hi")).alias("parts"))
    # an item's words meet its places once, and leave as stretches of at most twice a window each
    cut = F.transform("parts", lambda x: F.struct(x["h"].alias("h"), (x["at"] - x["lo"]).alias("place"), F.slice("item", x["lo"] + 1, x["hi"] - x["lo"] + F.col("size")).alias("stretch")))
    stretches = item_words(items, item_text, item_id, window).join(of_item, ["item_key", "size"]).select("item_id", "size", F.inline(cut))
    prefixes = written(stretches.groupBy("h", "place", "stretch", "size").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("prefix", F.monotonically_increasing_id()))

    met = joined(seen, prefixes.select("h", "prefix", "place", "size", F.size("stretch").alias("length")), "h").withColumn("begin", F.col("at") - F.col("place"))
    # what lies on either side of the shingle in the document must leave room for a window
    room = F.least(F.col("n") - F.col("begin"), F.col("length")) - F.greatest(-F.col("begin"), F.lit(0)) >= F.col("size")
    # the places of a prefix in a document are one entry of four bytes a place; its words and items stand beside them once
    begins = met.where(room).groupBy("id", "text_key", "prefix").agg(F.collect_set("begin").alias("begins"))
    facts = prefixes.select("prefix", "place", "size", "stretch", "items")
    whole = begins.join(F.broadcast(facts) if small(facts, BROADCAST_ROWS) else facts, "prefix")
    return whole.groupBy("id", "text_key").agg(F.collect_list(F.struct("begins", "place", "size", "stretch", "items")).alias("met"))


def verified(rows: DataFrame) -> DataFrame:
    """Keyed rows with ``met`` and the words ``w``: with ``runs``, the stretches of words (first, after, items) that are windows' words."""

    def run(c: Column, begin: Column) -> Column:
        left, right = _equal_run(F.col("w"), c["stretch"], begin, c["place"])
        at = begin + c["place"]
        return F.struct((at - left).alias("first"), (at + right).alias("after"), c["size"].alias("size"), c["items"].alias("items"))

    def of_prefix(c: Column) -> Column:
        return F.filter(F.transform(c["begins"], lambda begin: run(c, begin)), lambda r: r["after"] - r["first"] >= r["size"])

    return rows.withColumn("runs", F.when(F.col("met").isNull(), F.lit(None)).otherwise(F.flatten(F.transform("met", of_prefix))))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: (id, text_key, n_words, n_hit, items): its words, those within windows, and the sorted ids of their items."""
    lists = written(candidates(docs, items, text, id, **options))
    kind = lists.schema["met"].dataType.elementType["items"].dataType
    rows = verified(with_lists(keyed(docs, text, id), lists, "met").select("id", "text_key", "met", words(F.col("t")).alias("w")))
    ordered = F.array_sort(F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["after"].alias("after"))))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    union = F.aggregate(ordered, start, lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0), x["after"] - F.greatest(s["upto"], x["first"]))).alias("covered"), F.greatest(s["upto"], x["after"]).alias("upto")))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: r["items"]))))
    return rows.select(F.col("id").alias(id), "text_key", F.size("w").cast("bigint").alias("n_words"), F.coalesce(union["covered"], F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(found, F.array().cast(kind)).alias("items"))


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs.

    Only rows with candidates are split into words again; an anti-join on id and text takes them out.
    """
    lists = written(candidates(docs, items, text, id, **options))
    asked = with_lists(keyed(docs, text, id), lists, "met").where("met is not null").select("id", "text_key", "met", words(F.col("t")).alias("w"))
    # written before it is filtered: a filter on the runs would be moved below the projection of the words and split them for every candidate
    marked = written(verified(asked).select("id", "text_key", (F.size("runs") > 0).alias("hit"))).where("hit").select("id", "text_key").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names).withColumn("k", F.xxhash64(names[docs.columns.index(text)]))
    table = F.broadcast(marked) if small(marked, BROADCAST_ROWS) else marked
    return given.join(table, F.col(names[docs.columns.index(id)]).eqNullSafe(marked.id) & (F.col("k") == marked.text_key), "left_anti").drop("k").toDF(*docs.columns)
