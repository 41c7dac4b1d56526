"""URL filters: rules, and a ratio of character language models where no rule fits.

URLs that rules accept or reject train one model each: smoothed variable-order Markov models over
characters. The probability of a character after a context mixes the counts of the context with the
probability after the shorter one (Witten-Bell: the more kinds of successors, the more weight on the
shorter context); a context not seen leaves it to the shorter one altogether. A URL's score is the
difference of its two log-likelihoods divided by its length; the threshold is the score that splits
rejected from accepted URLs of a held-out fold best.

Built-in functions only. Equal URLs are one row with a count. One pass counts the grams of the longest
order, with map-side combination; all shorter contexts are sums over that table, and the table of grams
holds every gram of every URL, so scoring is one join. Log ratios are summed as whole millionths, so
the order of summing does not matter. Null URLs and URLs without ``://`` have empty host and path; the
models judge them by their characters, a null or empty URL by none: it is allowed. A score on the
threshold is allowed; of rules of equal length the last by name wins; equal URLs get equal verdicts, so
repeated rows too; an empty table gives no rows; columns that bear a result's name are replaced, all others
stay. Very long URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import quoted, small, written

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Characters of the longest gram (context and character), the alphabet of the uniform start, held-out share 1/FOLDS, score buckets.
ORDER, ALPHABET, FOLDS, BUCKETS = 5, 256, 5, 400
BROADCAST_ROWS = 300_000
#: A URL's score is handed to its rows by broadcast if it has over HOT_ROWS of them and over 1/HOT_SHARE of all.
HOT_ROWS, HOT_SHARE = 1000, 100_000
UNIT = 1_000_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first, as the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """(keep…, g): the gram that ends at each character of the lowered URL, filled up at its start. The URL does not stand beside its grams, and each is read off its place in an array."""
    filled = F.concat(F.lit("\x02" * (order - 1)), F.lower("url"), F.lit("\x03"))  # lowered it can be longer than the URL
    split = urls.select(*keep, F.split(filled, "").alias("c"))
    places = split.select(*keep, "c", F.explode_outer(F.sequence(F.lit(0), F.size("c") - order)).alias("i"))
    return places.select(*keep, F.concat(*[F.get("c", F.col("i") + j) for j in range(order)]).alias("g"))


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, ratio): for each gram its log probability when rejected less that when accepted, in millionths.

    ``counts``: (g, n_allow, n_block), one row a gram; grams of shorter contexts are sums over it.
    """
    sides = ("allow", "block")
    known = None
    for k in range(1, order + 1):
        end = counts.select(F.substring("g", order - k + 1, k).alias("s"), *[f"n_{c}" for c in sides])
        level = end.groupBy("s").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in sides]).withColumn("context", F.substring("s", 1, k - 1))
        context = level.groupBy("context").agg(*[x for c in sides for x in (F.sum(f"n_{c}").alias(f"all_{c}"), F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}"))])
        joined = level.join(context, "context")
        if known is not None:
            joined = joined.withColumn("shorter", F.substring("s", 2, k - 1)).join(known, "shorter")
        for c in sides:
            lower = F.lit(1.0 / ALPHABET) if known is None else F.col(f"p_{c}")
            whole = F.col(f"all_{c}") + F.col(f"kinds_{c}")
            joined = joined.withColumn(f"q_{c}", F.when(whole > 0, (F.col(f"n_{c}") + F.col(f"kinds_{c}") * lower) / whole).otherwise(lower))
        known = written(joined.select(F.col("s").alias("shorter"), *[F.col(f"q_{c}").alias(f"p_{c}") for c in sides]))
    return known.select(F.col("shorter").alias("g"), F.round((F.log("p_block") - F.log("p_allow")) * UNIT).cast("bigint").alias("ratio"))


def judged(df: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``df`` with host, path, rule, verdict and score (null for a null or empty URL); columns of these names are replaced."""
    given = F.col(quoted(url))
    urls = df.where(given.isNotNull() & (F.length(given) > 0)).groupBy(given.alias("url")).agg(F.count("*").alias("n"))
    _, sure = rule(host(F.col("url")), path(F.col("url")), rules)
    # 128 bits name a URL beside its grams
    urls = urls.withColumns({"key": F.xxhash64("url"), "other": F.xxhash64(F.lit("other"), "url")})
    urls = written(urls.withColumn("sure", sure).withColumn("held", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)) == 0))
    teaches = lambda v: F.sum(F.when((F.col("sure") == v) & ~F.col("held"), F.col("n")).otherwise(F.lit(0)))
    counts = written(_grams(urls, order, ["n", "sure", "held"]).groupBy("g").agg(teaches("allow").alias("n_allow"), teaches("block").alias("n_block")))
    ratios = log_ratios(counts, order)
    table = F.broadcast(ratios) if small(ratios, BROADCAST_ROWS) else ratios
    by_key = _grams(urls, order, ["key", "other"]).join(table, "g").groupBy("key", "other").agg((F.sum("ratio") / F.lit(float(UNIT)) / F.count("*")).alias("score"))
    scored = written(urls.join(by_key, ["key", "other"]).select("url", "n", "sure", "held", "score"))
    limit = threshold(scored)
    wanted = ("host", "path", "rule", "verdict", "score")
    rest = [c for c in df.columns if c.lower() not in wanted]
    # carried columns and the URL get names of their own, so any names will do
    carried = [f"c{i}" for i in range(len(rest))]
    rows = df.select(*[F.col(quoted(c)).alias(x) for c, x in zip(rest, carried, strict=True)], given.alias("u"))
    out = None
    for part, score in _parts(rows, scored):
        h, p = host(F.col("u")), path(F.col("u"))
        parts = part.select(*carried, h.alias("host"), p.alias("path"), score.alias("score"))
        name, verdict = rule(F.col("host"), F.col("path"), rules)
        own = F.when(F.col("score") > limit, F.lit("block")).otherwise(F.lit("allow"))
        one = parts.select(*carried, "host", "path", name.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
        out = one if out is None else out.unionByName(one)
    return out.toDF(*rest, "host", "path", "rule", "score", "verdict")


def _parts(rows: DataFrame, scored: DataFrame) -> list[tuple[DataFrame, Column]]:
    """``rows`` in three parts, each with its score: those without a URL, those of URLs with very many rows (by broadcast: HOT_SHARE URLs at most), and the others, by shuffle."""
    bare = F.col("u").isNull() | (F.length("u") == 0)
    total = scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = scored.select(F.col("url").alias("u"), "score", (F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).alias("many"))
    hot, cold = table.where("many").drop("many"), table.where(~F.col("many")).drop("many")
    named = rows.where(~bare)
    out = [(rows.where(bare), F.lit(None).cast("double"))]
    if small(hot, HOT_SHARE):
        return [*out, (named.join(F.broadcast(hot), "u"), F.col("score")), (named.join(F.broadcast(hot.select("u")), "u", "left_anti").join(cold, "u"), F.col("score"))]
    return [*out, (named.join(table, "u"), F.col("score"))]  # very long URLs: as one join, whose large partitions Spark can split


def threshold(scored: DataFrame) -> float:
    """The score above which held-out URLs are rejected best: the mean of both sides' shares of right verdicts is largest. Infinite where a side has no URL."""
    bucket = F.least(F.greatest(F.floor((F.col("score") + 4) * (BUCKETS / 8)), F.lit(0)), F.lit(BUCKETS - 1)).alias("bucket")
    held = scored.where("held and sure is not null").groupBy(bucket).agg(F.sum(F.when(F.col("sure") == "block", F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("sure") == "allow", F.col("n")).otherwise(0)).alias("allow"))
    rows = {r[0]: (r[1], r[2]) for r in held.collect()}  # at most BUCKETS rows
    blocks, allows = sum(b for b, _ in rows.values()), sum(a for _, a in rows.values())
    if not blocks or not allows:
        return float("inf")
    best, at, below_block, below_allow = -1.0, [0], 0, 0
    for k in range(BUCKETS):
        right = (blocks - below_block) / blocks + below_allow / allows
        if right > best + 1e-12:
            best, at = right, [k]
        elif abs(right - best) <= 1e-12:
            at.append(k)
        b, a = rows.get(k, (0, 0))
        below_block, below_allow = below_block + b, below_allow + a
    middle = at[len(at) // 2] if at == list(range(at[0], at[0] + len(at))) else at[0]
    return middle * 8 / BUCKETS - 4
