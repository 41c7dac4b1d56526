"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gives counts (words, symbols, repeated lines, repeated word windows, upper-case words) and
from them ratios, smoothed by a prior of ``PRIOR`` words or lines, so that one symbol in a short text is
no outlier. For each language and source a sketch of every ratio is gathered: counts in logarithmic
buckets, of relative error ``ERROR``, which merge by addition and so combine before the shuffle, whatever
share of the rows one source holds. To a group's sketch come those of its language and of all rows, each
scaled to ``WEIGHT`` rows: a small group leans on them, a large one goes its own way, and nothing
switches at a size.

A threshold lies where the group's own distribution ends: it is the upper end of the first range above the
median, ``GAP`` wide as a factor, that holds under ``TAIL`` of the rows. So there is no fixed cutoff: a
source full of symbols keeps its texts, one where symbols are unknown loses the few that are full of
them. Thresholds are then joined to the rows. A text is compared by what its count tells for sure: the count
less ``SURE`` times its root, so a few symbols or capitals, which in a short text make a large ratio, are no
outlier beside long texts, and a text without a trait is never odd in it.

Null texts have no words; a null language or source counts as the empty string. A text with under ten
words or with over a fifth of its words in repeated windows fails outright and is in no sketch. Equal
values share a bucket and so a verdict; repeated rows each get theirs; an empty table gives no rows; other
columns are not carried, so none can clash. Very long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.columns import append_columns, quoted, small, written

ERROR, WEIGHT = 0.05, 200
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Words or lines by which a text's ratios are smoothed, the width of an empty range as a factor, and 1/TAIL: the share of rows under which it counts as empty.
PRIOR, GAP, TAIL = 30, 4.0, 200
#: Standard deviations of a count, taken as its root, that are subtracted before it is compared.
SURE = 2
WIDTH = math.ceil(math.log(GAP) / math.log(GAMMA))
#: Each ratio's count and what it is of.
RATIOS = {"symbol_ratio": ("n_symbols", "n_words"), "upper_share": ("n_upper_words", "n_words"), "dup_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
BROADCAST_ROWS = 200_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")


def measure(text: str | None, window: int = 5) -> tuple[int, ...]:
    """The counts of a whole text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated(words, window), len(lines),
        sum(len(w) > 1 and w.isupper() for w in words),
    )


def repeated(words: list[str], size: int) -> int:
    """Words within windows that occur twice or more, all occurrences included."""
    windows = list(zip(*[words[i:] for i in range(size)], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts and ratios of each text."""

    def make():
        def run(texts):
            return list(map(list, zip(*map(measure, texts), strict=True)))

        return run

    out = append_columns(df, [text], make, ", ".join(f"{c} bigint" for c in COUNTS))
    return out.withColumns({m: (F.col(a) + 0.5) / (F.col(b) + PRIOR) for m, (a, b) in RATIOS.items()})


def bucket(value: Column) -> Column:
    """The logarithmic bucket of a positive value."""
    return F.ceil(F.log(value) / math.log(GAMMA)).cast("int")


def sketches(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """A row (by…, metric, bucket, n) for each bucket that has rows; values are positive."""
    each = F.array(*[F.struct(F.lit(v).alias("metric"), bucket(F.col(v)).alias("bucket")) for v in values])
    return df.select(*by, F.inline(each)).groupBy(*by, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of wider groups."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """A row (by…, metric, rows, one column a share): the values below which those shares of a group lie."""
    group = Window.partitionBy(*by, "metric")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    value = 2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1)
    run = sketch.select(*by, "metric", upto.alias("upto"), F.sum("n").over(group).alias("rows"), value.alias("value"))
    return run.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), *[F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("value"))).alias(name) for name, q in shares.items()])


def blended(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Sketches of (lang, source), each with its language's and the whole table's added as ``weight`` rows: (lang, source, metric, bucket, n).

    All are multiplied by the rows of the language and of the table, so ``n`` is a whole number (as a
    double: exact up to 2^53, and beyond that rounded alike for any partitioning).
    """
    wide, whole = merged(sketch, ["lang"]), merged(sketch, [])
    of_lang = wide.groupBy("lang", "metric").agg(F.sum("n").cast("double").alias("r_lang"))
    of_all = whole.groupBy("metric").agg(F.sum("n").cast("double").alias("r_all"))
    scales = of_lang.join(F.broadcast(of_all), "metric")  # a row for each language and ratio, and one for each ratio
    groups = sketch.select("lang", "source", "metric").distinct()
    own = sketch.join(scales, ["lang", "metric"]).withColumn("n", F.col("n") * F.col("r_lang") * F.col("r_all"))
    near = groups.join(wide, ["lang", "metric"]).join(scales, ["lang", "metric"]).withColumn("n", weight * F.col("n") * F.col("r_all"))
    far = groups.join(F.broadcast(whole), "metric").join(scales, ["lang", "metric"]).withColumn("n", weight * F.col("n") * F.col("r_lang"))  # some hundred buckets
    names = ["lang", "source", "metric", "bucket", "n"]
    return own.select(*names).unionByName(near.select(*names)).unionByName(far.select(*names)).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by…, metric, last): the last bucket that is not odd: the end of the first range of GAP, from the median on, that is as good as empty."""
    order = Window.partitionBy(*by, "metric").orderBy("bucket")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.coalesce(F.sum("n").over(order.rangeBetween(1, WIDTH)), F.lit(0.0))
    run = sketch.select(*by, "metric", "bucket", upto.alias("upto"), after.alias("after"), F.sum("n").over(Window.partitionBy(*by, "metric")).alias("rows"))
    return run.where((2 * F.col("upto") >= F.col("rows")) & (TAIL * F.col("after") < F.col("rows"))).groupBy(*by, "metric").agg((F.min("bucket") + WIDTH).alias("last"))


def thresholds(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row (lang, source, last_<ratio>…) for each group of measured rows that has one that passes the outright rules."""
    rows = df.where(~failed()).select(F.coalesce(quoted(lang), F.lit("")).alias("lang"), F.coalesce(quoted(source), F.lit("")).alias("source"), *RATIOS)
    sketch = written(sketches(rows, ["lang", "source"], list(RATIOS)))
    each = limits(blended(sketch), ["lang", "source"])
    return each.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("last"))).alias(f"last_{m}") for m in RATIOS])


def failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(df: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of ``df``: its id, counts, ratios, the last buckets that are not odd in its group, base_failed and kept."""
    narrow = df.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("t"), F.coalesce(quoted(lang), F.lit("")).alias("lang"), F.coalesce(quoted(source), F.lit("")).alias("source"))
    rows = written(measured(narrow, "t").drop("t"))
    table = written(thresholds(rows, "lang", "source"))
    out = rows.join(F.broadcast(table) if small(table, BROADCAST_ROWS) else table, ["lang", "source"], "left")
    odd = F.lit(False)
    for m, (count, of) in RATIOS.items():
        least = F.col(count) - SURE * F.sqrt(F.col(count))
        odd = odd | F.coalesce((least > 0) & (bucket((least + 0.5) / (F.col(of) + PRIOR)) > F.col(f"last_{m}")), F.lit(False))
    return out.withColumn("base_failed", failed()).withColumn("kept", ~failed() & ~odd).withColumnRenamed("id", id)
