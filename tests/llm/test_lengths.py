"""Very long items and URLs, and short texts beside long ones."""

import time

import pytest

from granary.llm import decontamination, quality, url_model


def test_a_long_item_takes_seconds(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(100_000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[500:520])), (None, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "start " + " ".join(words[70_000:70_030]) + " end"), (2, "nothing of it"), (3, " ".join(words[505:516]))], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_hit, sorted(r["items"])) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (30, [1]), 2: (0, []), 3: (11, [1, 2])}
    assert time.perf_counter() - began < 90


def test_a_long_url_takes_seconds(spark):
    urls = [(1, "http://example.net/en/" + "a/b-c" * 20_000), (2, "http://example.com/de/" + "é😀" * 50), (3, "http://other.org/x"), (4, None)]
    began = time.perf_counter()
    got = {r.page_id: r for r in url_model.judged(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert (got[1].verdict, got[1].rule, got[2].host, got[4].score) == ("allow", "example.net/en/", "example.com", None)
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("short", ["one two three four five six seven eight nine # eleven twelve", "all of this is about the USA and the EU today, said NATO"])
def test_short_texts_beside_long_ones_are_kept(spark, short):
    long = [(i, " ".join(f"word{i}x{j}" for j in range(3000)), "en", "s") for i in range(300)]
    junk = [(1001, " ".join(["#$% &|<>"] + [f"j{k} $$" for k in range(30)]), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([*long, (1000, short, "en", "s"), *junk], "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()}
    assert got[1000] and not got[1001] and all(got[i] for i in range(300))
