"""The pipeline's rows against a brute-force run of its stages."""

import hashlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from granary.llm import pii, piece_encoding, toxicity

from .test_operators import contaminated, fingerprint, linked


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    chain = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = sorted(texts)
    toxic = chain.probabilities([texts[i] for i in ids])[:, -1] >= chain.threshold
    assert 0 < toxic.sum() < 0.3 * len(ids)
    texts = {i: texts[i] for i, x in zip(ids, toxic, strict=True) if not x}

    roots = linked({i: fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not contaminated(t, items)[1]}
    assert got.keys() == texts.keys()

    m = piece_encoding.merges(piece_encoding.default_model()).processor
    for i, t in texts.items():
        t = pii.redacted(t, pii.find([t])[0])
        ids = m.encode(t, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].text == m.decode(ids)


def test_stages_leave_only_the_result(spark, sf, tmp_path, monkeypatch):
    import os

    from granary import session

    monkeypatch.setattr(session, "_base", lambda spark: str(tmp_path))
    with session.folders() as mine:
        out = corpus_pipeline.run(spark, sf)
        assert len(os.listdir(tmp_path)) == 1 and out.count() > 0
        session.release(spark, mine)
    assert not os.listdir(tmp_path) and not mine


def test_the_pipeline_leaves_tables_of_other_threads(spark, sf, tmp_path, monkeypatch):
    import threading

    from granary import session

    monkeypatch.setattr(session, "_base", lambda spark: str(tmp_path))
    started, done, held = threading.Event(), threading.Event(), []

    def other():
        started.wait()
        held.append(session.written(spark.range(7).toDF("n")))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    stage = corpus_pipeline.STAGES[2]

    def between(spark, docs, sf_dir):
        started.set()
        done.wait(60)
        return stage[1](spark, docs, sf_dir)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(stage[0], between), corpus_pipeline.STAGES[3]])
    corpus_pipeline.run(spark, sf)
    thread.join()
    assert held[0].count() == 7


def test_stages_on_odd_rows(spark, sf):
    """Very long texts, and extra columns named like those that stages use inside."""
    names = ("toxic", "p_toxic", "__toxic", "a.b", "c0", "k", "id", "simhash", "met", "out0", "in0")
    rows = [(1, "word " * 200000, "en", "s", 1000000), (2, "y" * 300000, "en", "s", 300000), (3, None, None, None, None), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (None, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in names:
        docs = docs.withColumn(c, F.lit("extra"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["a.b"] for r in got} == {r["toxic"] for r in got} == {"extra"}
        assert len(got) == {"simhash_near_dedup": 4}.get(name, 6), name


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for given in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= given.count()
        assert corpus_pipeline.encode(spark, given, sf).count() == given.count()
