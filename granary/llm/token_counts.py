"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree whose nodes hold the sums of characters and
tokens below. An edit descends by characters to the leaves that it touches, takes ``MARGIN``
characters of context before it and what white space stands before these (as far as a pre-token pattern
looks ahead: over a run of white space to its end, else a few characters), splits that region anew and
goes on to the right until a new boundary meets an old one with such context behind it: from there on
the pattern, which never looks back, splits as before. Only the region's pre-tokens are encoded again;
their sums go up the tree.

Positions are code points; an edit (start, end, text) replaces [start, end) of the text as it is
when its turn comes, and is cut to the text's length. Null texts count as empty, null edits as none,
an edit's null text as empty. Edits that tie in place are applied in their order; repeated rows each get
their result; an empty table gives no rows; columns that bear a result's name are replaced, all others
stay. Very long texts are read whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from granary.llm.columns import append_columns

#: Characters after a pre-token's end that can decide where it ends.
MARGIN = 4
_CACHE, _CACHE_CHARS = 200_000, 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Counter(dict):
    """Tokens of a pre-token, kept for those seen before."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        super().__init__()
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= _CACHE_CHARS:
            if len(self) >= _CACHE:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(ranks_file: str, pattern: str) -> Counter:
    return Counter(ranks_file, pattern)


class CountTree:
    """The pre-tokens of a text under edits, with the number of tokens of the whole and of any part."""

    def __init__(self, text: str, count: Counter):
        self.count = count
        self._build(count.split(text))
        self.encoded = len(self.leaves)

    def _build(self, pieces: list[str]) -> None:
        self.leaves: list[list[str]] = [[p] for p in pieces] or [[]]
        self.size = size = 1 << max(0, len(self.leaves) - 1).bit_length()
        rest = [0] * (size - len(pieces))
        self.chars = self._sums([len(p) for p in pieces] + rest)
        self.tokens = self._sums(list(map(self.count.__getitem__, pieces)) + rest)

    @staticmethod
    def _sums(level: list[int]) -> list[int]:
        """The nodes of the tree over these leaves: the root at 1, the children of i at 2i and 2i + 1."""
        levels = [level]
        while len(level) > 1:
            level = [a + b for a, b in zip(level[::2], level[1::2], strict=True)]
            levels.append(level)
        return [0, *(x for found in reversed(levels) for x in found)]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one with characters, if it lies at the end), and where the leaf starts."""
        if not self.chars[1]:
            return 0, 0
        at = max(0, min(at, self.chars[1] - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _before(self, leaf: int, start: int) -> tuple[int, int]:
        """The last leaf up to this one that follows no white space, and where it starts: how a run of white space splits depends on all of it."""
        while True:
            prior = leaf - 1
            while prior >= 0 and not self.leaves[prior]:
                prior -= 1
            if prior < 0 or not self.leaves[prior][-1][-1].isspace():
                return leaf, start
            leaf, start = prior, start - self.chars[prior + self.size]

    def _set(self, leaf: int, pieces: list[str], tokens: int) -> None:
        self.leaves[leaf] = pieces
        i = leaf + self.size
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str | None) -> None:
        new = new or ""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, origin = self._before(*self.find(start - MARGIN))
        last, at = self.find(end)
        body = "".join(p for leaf in self.leaves[first : last + 1] for p in leaf)
        body = body[: start - origin] + new + body[end - origin :]
        changed = start - origin + len(new)  # from here on the text is as before
        ends = {len(body): last}  # where a leaf after the edit ends, in the new text
        step = 1
        while True:
            upto = min(len(self.leaves) - 1, last + step)
            parts, n = [body], len(body)
            for i in range(last + 1, upto + 1):
                piece = "".join(self.leaves[i])
                if piece:
                    parts.append(piece)
                    n += len(piece)
                    ends[n] = i
            body, last = "".join(parts), upto
            whole = upto == len(self.leaves) - 1
            settled = len(body.rstrip())  # what ends the body may be a run of white space that goes on
            pieces, n = [], 0
            for p in self.count.split(body):
                pieces.append(p)
                n += len(p)
                if n in ends and n >= changed and n + MARGIN <= settled:
                    return self._replace(first, ends[n], pieces)
            if whole:
                return self._replace(first, last, pieces)
            step *= 2

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        self.encoded += len(pieces)
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self._set(i, [], 0)
        self._set(first, pieces, sum(map(self.count.__getitem__, pieces)))
        if len(pieces) > 64 and len(pieces) > len(self.leaves) // 2:
            # a leaf that holds most of the text is dealt out again
            self._build([p for leaf in self.leaves for p in leaf])


def count_edited(text: str | None, edits: Iterable | None, count: Counter) -> tuple[int, int, int, int, int]:
    """Tokens before and after the edits, characters after, pre-tokens of the whole, and those encoded again."""
    tree = CountTree(text or "", count)
    before, whole = tree.n_tokens, tree.encoded if text else 0
    tree.encoded = 0
    for e in edits or ():
        if e is not None:
            tree.edit(e["start"] or 0, e["end"] or 0, e["text"])
    return before, tree.n_tokens, tree.n_chars, whole, tree.encoded


def count_tokens(df: DataFrame, text: str = "text", edits: str = "edits", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with n_tokens and, after the column ``edits`` (array<struct<start, end, text>>) is applied, n_tokens_edited, n_chars_edited; also n_pretokens and n_reencoded."""
    ranks, pat = ranks_file or default_ranks(), pattern or default_pattern()

    def make():
        c = counter(ranks, pat)

        def run(texts, changes):
            return list(map(list, zip(*(count_edited(t, e, c) for t, e in zip(texts, changes, strict=True)), strict=True)))

        return run

    return append_columns(df, [text, edits], make, "n_tokens bigint, n_tokens_edited bigint, n_chars_edited bigint, n_pretokens bigint, n_reencoded bigint")
