"""The registered queries of these operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, html_wrappers, lexical_search, license_scan, oracle, periodic_runs, pii, piece_encoding, quality, simhash, substring_dedup, token_counts, toxicity, url_model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def _digest(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter("pii", _of(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii")).alias("spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("text_key")


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = piece_encoding.encode_decode(docs)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.classify(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in chain.categories], F.col("is_toxic").alias("toxic"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every text: twelve characters go after a quarter, a note comes in at half, seven characters change after three quarters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    place = lambda a, b, text: F.struct(F.floor(n * a).cast("int").alias("start"), (F.floor(n * a) + b).cast("int").alias("end"), F.lit(text).alias("text"))
    out = token_counts.count_tokens(docs.withColumn("edits", F.array(place(0.25, 12, ""), place(0.5, 0, " [edited]"), place(0.75, 7, "..."))))
    return out.select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded")


def op9_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = periodic_runs.find(docs.select("doc_id", periodic_runs.looped(F.col("text"), F.col("doc_id")).alias("text")))
    best = periodic_runs.greatest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return (
        out.select("doc_id", "runs", "collapsed", best.alias("best"))
        .select(
            "doc_id",
            F.size("runs").cast("bigint").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_wrappers": op1_html_wrappers,
    "op2_personal_data": op2_personal_data,
    "op3_license_scan": op3_license_scan,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_url_model": op9_url_model,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
