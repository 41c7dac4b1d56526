"""The bounded caches of piece encoding: what is frequent stays, results do not depend on them."""

import random

import pytest

from granary.llm import piece_encoding as P


def test_frequent_words_outlive_a_full_cache():
    m = P.Merges(P.default_model(), 8)
    asked, word = [], m.word
    m.word = lambda w: (asked.append(w), word(w))[1]
    for i in range(40):
        m.encode(f"often rare{i}")
        assert len(m.cache) + len(m.cache.older) <= 8
    assert asked.count("▁often") == 1 and len(asked) == 41


@pytest.mark.parametrize("most", [2, P.MOST_PAIRS])
def test_ids_are_the_library_s_whatever_is_kept(monkeypatch, most):
    monkeypatch.setattr(P, "MOST_PAIRS", most)
    rng = random.Random(5)
    m = P.Merges(P.default_model(), 6)
    texts = ["".join(rng.choice("aeinrst  hTÉé漢▁\n\t😀01.,") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " ", "a" * 300]
    for t in texts:
        want = [m.begin, *m.processor.encode(t), m.end]
        assert m.encode(t).tolist() == want and m.decode(m.encode(t)) == m.processor.decode(want)
    assert len(m.pairs) + len(m.older_pairs) <= max(2, most)
