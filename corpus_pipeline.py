"""A document pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back as the next one's ``docs``. All but the last return the columns of
``documents``. No stage is left to SQL alone, so tests hold it against brute force.

What a stage writes on its way, and its input, is deleted once its own result is written; the last
result stays. Every stage takes null, empty and very long texts, repeated rows, null ids, empty tables
and extra columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, pii, piece_encoding, simhash, toxicity
from granary.session import folders, release, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not find toxic; null and empty texts stay."""
    chain = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    judged = toxicity.classify(docs.toDF(*names), chain, text=names[docs.columns.index("text")], to="toxic", prefix="p_")
    return judged.where("not toxic").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with the smallest id; of rows alike in id and text one. Null and empty texts are one group; rows without an id stay."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts hold none."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text. A null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids (little-endian unsigned 32-bit), how many they are, their digest, and the decoded text; a null text counts as empty."""
    out = piece_encoding.encode_decode(docs, ids="ids", decoded="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with folders() as mine:
            made = stage(spark, docs, sf_dir)
            path = shared_folder(spark, "stage")
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
            release(spark, mine, (path,))
        release(spark, before)
        before = [path]
    return docs
