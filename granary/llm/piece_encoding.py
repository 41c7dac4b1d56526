"""SentencePiece encoding and decoding: exact BPE by backtracking over longest matches.

A merge-type tokenizer joins, again and again, the neighbouring pair whose union has the best score.
Its result is the one sequence of tokens in which every two neighbours are *compatible*: merging the
characters of the pair from scratch gives that pair back. So a text can be encoded from left to
right: take the longest token that starts here (an Aho-Corasick automaton over the reversed
vocabulary lists them for every position), accept it if it is compatible with the token before,
else try the next shorter one; where none is left, step back a token. A bitfield marks positions from
which the rest could not be finished, so no position is searched twice.

Pieces never hold the space mark after another character in usual models (checked when a model is
loaded), so a text falls into runs "marks and a word" that are encoded apart, and a bounded cache in
two halves keeps the results of words seen before: a full half displaces the older one, so what is
frequent is never lost. Characters that the vocabulary lacks become byte tokens.

Null and empty texts give the begin and end ids only and decode to the empty string.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame

from granary.llm.columns import append_columns

MARK = "▁"
#: Words kept by a task's cache, in both halves together. It bounds memory (about 240 bytes a word), not results.
CACHE_WORDS = 500_000
#: The same for pairs of tokens whose compatibility is known.
MOST_PAIRS = 500_000
#: Words over this many characters are encoded but not kept.
CACHE_CHARS = 64
#: The score of two neighbours that no piece joins.
NO_MERGE = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merges:
    """The merge rules of a model: pieces, scores, and the encoder by backtracking."""

    def __init__(self, model_file: str, cache_words: int = CACHE_WORDS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = pb.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.remove_extra_whitespaces or norm.precompiled_charsmap or not norm.escape_whitespaces:
            raise ValueError("this encoder is for models that leave the text as it is")
        if spec.trainer_spec.model_type != 2 or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this encoder is for BPE models with a leading space mark")
        kind = pb.ModelProto.SentencePiece
        if any(p.type == kind.USER_DEFINED for p in spec.pieces):
            raise ValueError("pieces defined by the user are not merged; this encoder has none")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.unknown = self.processor.unk_id()
        self.texts, self.size = [p.piece for p in spec.pieces], len(spec.pieces)
        self.chars = {p for p in self.ids if len(p) == 1}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            self.split = re.compile(r"(?s).+")
        else:  # no token goes over the start of a word, nor over a character that the vocabulary lacks
            gaps = "".join(c for c in "\n\t\r" if c not in self.chars)
            self.split = re.compile(f"{MARK}+[^{MARK}{gaps}]*|[^{MARK}{gaps}]+|[{gaps or MARK}]+")
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        self.cache = _Cache(self, cache_words)
        # the pieces that merging can reach, and for each the longest one that is a beginning of it
        reached = {p: (len(p), i) for p, i in self.ids.items() if all(c in self.chars for c in p) and self.merged(p) == [p]}
        self.shorter: list[tuple[int, int] | None] = [None] * self.size
        self.matcher = ahocorasick.Automaton()
        for p, (_, i) in reached.items():
            self.shorter[i] = next((reached[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), None)
            self.matcher.add_word(p[::-1], reached[p])
        self.matcher.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, one by one: the best score first, the leftmost of equals."""
        parts = list(text)
        score = self.scores.get
        found = [score(a + b, NO_MERGE) for a, b in zip(parts, parts[1:], strict=False)]  # of each two neighbours
        while found and (best := max(found)) != NO_MERGE:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], NO_MERGE)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], NO_MERGE)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pieces of two ids stay as they are when their characters are merged from scratch."""
        key = left * self.size + right
        known = self.older_pairs.get(key)
        if known is None:
            a, b = self.texts[left], self.texts[right]
            known = self.merged(a + b) == [a, b]
        if len(self.pairs) >= MOST_PAIRS // 2:
            self.older_pairs = self.pairs.copy()
            self.pairs.clear()  # the same object, which ``pieces`` holds
        self.pairs[key] = known
        return known

    def pieces(self, run: str) -> list[int]:
        """The ids of a run of characters that all are in the vocabulary."""
        n, size, pairs, shorter = len(run), self.size, self.pairs, self.shorter
        # of the matches that end at one place of the reversed run the longest comes first, so it is put last
        longest = dict(list(self.matcher.iter(run[::-1]))[::-1])
        failed: bytearray | None = None
        out: list[int] = []
        next_choice: list[tuple[int, int] | None] = []  # for each token of out, what its start tries after it
        at, choice = 0, longest.get(n - 1)
        while at < n:
            last = out[-1] * size if out else -1
            while choice is not None:
                length, piece = choice
                choice = shorter[piece]
                to = at + length
                if failed is not None and failed[to >> 3] >> (to & 7) & 1:
                    continue
                if last >= 0:
                    fits = pairs.get(last + piece)
                    if not (self.compatible(out[-1], piece) if fits is None else fits):
                        continue
                out.append(piece)
                next_choice.append(choice)
                at = to
                choice = longest.get(n - 1 - at)
                break
            else:
                if not out:
                    raise ValueError("no sequence of compatible tokens")
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(self.texts[out.pop()])
                choice = next_choice.pop()
        return out

    def word(self, word: str) -> tuple[int, ...]:
        chars = self.chars
        if chars.issuperset(word):
            return tuple(self.pieces(word))
        out: list[int] = []
        at, n = 0, len(word)
        while at < n:
            to = at
            while to < n and word[to] in chars:
                to += 1
            if to > at:
                out += self.pieces(word[at:to])
            if to < n:
                c = word[to]
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                to += 1
            at = to
        return tuple(out)

    def encode(self, text: str | None) -> array:
        """All ids of ``text`` with begin and end, as unsigned 32-bit integers."""
        if not text:
            return array("I", (self.begin, self.end))
        words = self.split.findall(self.prefix + text.replace(" ", MARK))
        return array("I", chain((self.begin,), chain.from_iterable(map(self.cache.__getitem__, words)), (self.end,)))

    def decode(self, ids: array) -> str:
        return self.processor.decode(ids.tolist())


class _Cache(dict):
    """The younger half of the words kept; ``older`` is the half before it."""

    def __init__(self, merges: Merges, most: int):
        super().__init__()
        self.merges, self.most, self.older = merges, max(1, most // 2), {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merges.word(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def merges(model_file: str) -> Merges:
    return Merges(model_file)


def encode_decode(df: DataFrame, text: str = "text", model_file: str | None = None, ids: str = "ids", decoded: str = "decoded", count: str = "n_tokens") -> DataFrame:
    """``df`` with the ids of each whole text (little-endian unsigned 32-bit integers), their number and the text decoded from them.

    ``model_file`` must be readable under the same path on the executors. Columns of ``df`` named
    like a result are replaced; repeated rows stay repeated; an empty table stays empty.
    """
    import sys

    path = model_file or default_model()
    swap = sys.byteorder == "big"

    def make():
        m = merges(path)

        def run(texts):
            data, n, back = [], [], []
            for t in texts:
                a = m.encode(t)
                back.append(m.decode(a))
                n.append(len(a))
                if swap:
                    a.byteswap()
                data.append(a.tobytes())
            return [data, n, back]

        return run

    return append_columns(df, [text], make, f"{ids} binary, {count} bigint, {decoded} string")
