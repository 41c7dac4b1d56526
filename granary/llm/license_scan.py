"""License scans by diagonal voting.

Templates are word sequences: short phrases, notices, whole license texts and identifiers. Every rolling
word k-gram of a document joins the places of the same k-gram in the templates; each meeting is a vote for
the diagonal (place in the document minus place in the template). An exact occurrence puts all its votes
on one diagonal; inserted or dropped words move the votes to a neighbouring one, so diagonals at most
``SLACK`` apart merge to a span. The document's own words then decide: a vote counts if the gram's words
stand in order where its diagonal puts them. A phrase is found where one diagonal has all votes, another
template where those of a merged span cover the share that it needs.

Built-in functions only; the votes, not the texts, are grouped. Null and empty texts have no words. Equal
labels count once; overlapping spans all count; repeated rows each get their result; an empty table gives
no rows; other columns are not carried, so none can clash. Very long texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.columns import written
from granary.llm.license_texts import NOTICES, PHRASES
from granary.llm.wordgrams import gram, joined, keyed, occurrences, with_lists, words

#: Words of a rolling gram (shorter templates use grams of their own length), and diagonals that merge.
GRAM, SLACK = 3, 2


def wordings(phrases=PHRASES, notices=NOTICES) -> list[list[str]]:
    """The words of each template, by its number: phrases first."""
    return [re.findall("[0-9a-z]+", text.lower()) for *_, text in [*phrases, *notices]]


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = GRAM) -> DataFrame:
    """A row (template, label, exact, need, k, total, place, h) for each k-gram of each template; ``need`` is the share that a span must cover."""
    given = [(label, True, 1.0) for label, _ in phrases] + [(label, False, need) for label, need, _ in notices]
    of = [(i, *g, w) for i, (g, w) in enumerate(zip(given, wordings(phrases, notices), strict=True)) if w]
    rows = spark.createDataFrame(of, "template int, label string, exact boolean, need double, w array<string>")
    rows = rows.withColumn("k", F.least(F.lit(k), F.size("w"))).withColumn("total", F.size("w") - F.col("k") + 1)
    places = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    h = F.lit(None).cast("bigint")
    for n in range(1, k + 1):
        h = F.when(F.col("k") == n, gram(F.col("w"), F.col("place"), n)).otherwise(h)
    return places.select("template", "label", "exact", "need", "k", "total", "place", h.alias("h"))


def spans(df: DataFrame, places: DataFrame, text: str = "text", id: str = "doc_id", slack: int = SLACK) -> DataFrame:
    """A row (id, text_key, template, exact, k, total, first, last, cover, votes) for each merged span of votes.

    first and last are its first and last word, cover is the share of the template's places that have a
    vote, votes are its diagonals with the places of each.
    """
    sizes = sorted(r[0] for r in places.select("k").distinct().collect())
    met = joined(occurrences(keyed(df, text, id), sizes), places.select("template", "exact", "k", "total", "place", "h"), "h")
    # rows alike in id and text vote the same; a diagonal's votes are the distinct places of the template
    by_diagonal = met.groupBy("id", "text_key", "template", "exact", "total", "k", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    order = Window.partitionBy("id", "text_key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > slack), F.lit(True))
    merged = by_diagonal.withColumn("span", F.sum(fresh.cast("int")).over(order))
    one = merged.groupBy("id", "text_key", "template", "exact", "total", "k", "span").agg(
        F.min(F.col("diagonal") + F.array_min("places")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("places") + F.col("k") - 1).alias("last"),
        F.collect_list(F.struct("diagonal", "places")).alias("votes"),
    )
    found = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda v: v["places"]))))
    return one.select("id", "text_key", "template", "exact", "k", "total", "first", "last", (found / F.col("total")).alias("cover"), "votes")


def scan(df: DataFrame, text: str = "text", id: str = "doc_id", phrases=PHRASES, notices=NOTICES, k: int = GRAM, slack: int = SLACK) -> DataFrame:
    """Per row of ``df``: (id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts the places of phrases, first_word and last_word are the smallest and largest start;
    labels also hold those of notices whose need is covered; score is the best cover of any template.
    """
    places = templates(df.sparkSession, phrases, notices, k)
    facts = places.select("template", "label", "need").distinct()
    # a span that cannot reach a half of its need tells nothing; the facts are a few hundred rows, the constant templates
    found = spans(df, places, text, id, slack).join(F.broadcast(facts), "template").where(F.when(F.col("exact"), F.col("cover") == 1.0).otherwise(2 * F.col("cover") >= F.col("need")))
    lists = written(found.groupBy("id", "text_key").agg(F.collect_list(F.struct("template", "label", "exact", "need", "k", "total", "first", "last", "votes")).alias("spans")))
    rows = with_lists(keyed(df, text, id), lists, "spans").select("id", "text_key", "spans", words(F.col("t")).alias("w"))
    known = F.lit(wordings(phrases, notices)) if phrases or notices else F.array(F.array().cast("array<string>"))

    def sure(s):
        """The share of the template's grams whose words, in their order, stand where a diagonal puts them."""
        of = F.get(known, s["template"])
        same = F.transform(s["votes"], lambda v: F.filter(v["places"], lambda p: F.slice(of, p + 1, s["k"]) == F.slice(F.col("w"), v["diagonal"] + p + 1, s["k"])))
        cover = F.size(F.array_distinct(F.flatten(same))) / s["total"]
        return F.struct(s["label"].alias("label"), s["exact"].alias("exact"), s["first"].alias("first"), s["need"].alias("need"), cover.alias("cover"))

    rows = rows.withColumn("sure", F.filter(F.transform("spans", sure), lambda s: ~s["exact"] | (s["cover"] == 1.0)))
    base = F.filter("sure", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["first"])
    named = F.filter("sure", lambda s: s["cover"] >= s["need"])
    labels = lambda found: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ","), F.lit(""))
    return rows.select(
        F.col("id").alias(id), "text_key", F.size("w").cast("bigint").alias("n_words"), F.coalesce(F.size(base), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"), labels(base).alias("base_labels"),
        labels(named).alias("labels"), F.coalesce(F.array_max(F.transform("sure", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
