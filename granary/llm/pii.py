"""Personal data: candidate spans judged by boosted trees, beside exact base patterns.

High-recall generators propose spans, which may overlap: look-alikes by the base patterns without their checks (judged by trees of their own), local
telephone numbers, account and identity numbers, secrets after a keyword, spelled-out addresses, long
mixed runs. Each gets features of its format (lengths, digit share, check sums, separators, entropy) and
of its context (keywords and characters around it). Gradient-boosted trees, fitted on a seeded
generator of positive and negative examples, give a probability; a threshold for each kind, the
lowest at which held-out precision is ``PRECISION``, selects spans; where selected spans overlap, the
likelier stays. Base spans (matches that pass their check) always stay, and a span that overlaps one goes.

Null and empty texts have no spans. Offsets are code points, end exclusive. Of selected spans that meet
and are equally likely, the one first by kind, then place, stays; repeated rows each get their result; an
empty table gives no rows; a column that bears the result's name is replaced, all others stay. Very long
texts and very long runs are read whole.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import append_columns

BASE = ("email", "ip", "card", "phone")
EXTRA = ("account", "address", "identity", "local_phone", "secret")
#: Look-alikes of the base kinds: spans of their patterns that fail the checks.
LIKE = ("email_like", "ip_like", "card_like", "phone_like")
KINDS = BASE + EXTRA + LIKE
PRECISION = 0.98
#: Examples of either label in the generated training and held-out sets, and the trees.
EXAMPLES, TREES, DEPTH, RATE, BINS = 3000, 60, 4, 0.3, 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern: found from each @, so long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The spans of the base patterns that pass their checks, by start, then kind."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


#: Generators: wide patterns, each linear in the text and without a bound on a run's length. A span may come from several.
_WIDE = [
    ("secret", re.compile(r"(?i)(?<![a-z])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_/+=.-]{8,}+)"), 1),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=.-])([A-Za-z0-9_]{24,}+)(?![A-Za-z0-9_/+=.-])"), 1),
    ("account", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), 1),
    ("identity", re.compile(r"(?<![0-9.-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), 1),
    ("identity", re.compile(r"(?<![A-Za-z0-9.-])([A-Z]{1,2}[0-9]{6,9}[A-Z]?)(?![A-Za-z0-9-])"), 1),
    ("local_phone", re.compile(r"(?<![0-9+.-])(\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4})(?![0-9-])"), 1),
    ("address", re.compile(r"(?i)(?<![a-z0-9._-])([a-z0-9._-]{2,}+\s?[\[(]?\s?(?:at|@)\s?[\])]?\s?[a-z0-9-]{2,}+\s?[\[(]\s?dot\s?[\])]\s?[a-z]{2,}+)(?![a-z0-9])"), 1),
]
_LOOKALIKES = [
    ("email_like", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?@\x20?[A-Za-z0-9-]{2,}+(?:\x20?[.,]\x20?[A-Za-z0-9-]{2,}+)*+(?![A-Za-z0-9@-])")),
    ("ip_like", re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?!\.?[0-9])")),
    ("card_like", re.compile(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])")),
    ("phone_like", re.compile(r"(?<![A-Za-z0-9+])\+[0-9][\x20().0-9-]{4,24}[0-9](?![0-9])")),
]
_HINT = re.compile(r"(?i)[0-9]|token|secret|passw|key|auth|dot|[A-Z0-9_]{24}")
_CUES = {
    "secret": ("token", "secret", "passw", "key", "auth"),
    "account": ("iban", "account", "konto", "cuenta", "compte"),
    "identity": ("ssn", "social", "passport", "id no", "identity", "licence no", "ausweis"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile", "ruf"),
    "address": ("mail", "contact", "write", "reach"),
    "email_like": ("mail", "contact", "write", "reach"),
    "ip_like": ("ip", "host", "server", "addr"),
    "card_like": ("card", "visa", "credit", "karte", "tarjeta"),
    "phone_like": ("tel", "phone", "call", "fax", "mobile", "ruf"),
}
_TOP = [[x] for x in ("com", "org", "net", "edu", "de", "fr", "es", "uk", "io")]
_AGAINST = ("version", "isbn", "sha", "md5", "commit", "page", "order", "date", "total", "price", "build", "rev")


def candidates(text: str) -> list[tuple[str, int, int]]:
    if not _HINT.search(text):
        return []
    return sorted({(kind, *m.span(g)) for kind, p, g in _WIDE for m in p.finditer(text)}, key=lambda s: (s[1], s[2], s[0]))


def lookalikes(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns whether they pass their checks or not; telephone numbers of seven digits at least."""
    out = []
    for kind, p in _LOOKALIKES:
        if ("+" if kind == "phone_like" else "@" if kind == "email_like" else "") in text:
            out += [(kind, *m.span()) for m in p.finditer(text) if kind != "phone_like" or len(_DIGIT.findall(m[0])) >= 7]
    return out


def _mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """The features of a span: its kind, format and context."""
    s = text[start:end]
    bare = re.sub(r"[\W_]", "", s)
    n, digits = max(1, len(bare)), sum(c.isdigit() for c in bare)
    counts = Counter(bare)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    return [
        float((LIKE if kind in LIKE else EXTRA).index(kind)), float(n), digits / n, sum(c.isupper() for c in bare) / n, entropy,
        float(sum(not c.isalnum() for c in s)), float(len(set(re.findall(r"[\W_]", s)))),
        float(kind == "account" and len(bare) >= 15 and _mod97(bare)), float(digits == n and luhn(bare)),
        float(any(c in before for c in _CUES[kind])), float(any(c in before for c in _AGAINST)),
        float(before[-1:] in ("=", ":", '"', "'")), float(after[:1] in ('"', "'")), float(before[-1:].isalnum()),
        float(all(c in "0123456789abcdefABCDEF" for c in bare)), float(0 < digits < n), float(len(counts) / n),
        float(re.findall("[A-Za-z]+", s[-24:])[-1:] in _TOP),
    ]


def describe_like(text: str, kind: str, start: int, end: int) -> list[float]:
    """The features of a look-alike: those of other spans, and its groups of digits."""
    s = text[start:end]
    groups = re.findall("[0-9]+", s) or [""]
    sizes = [len(g) for g in groups]
    return [
        *describe(text, kind, start, end), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(max(int(g or 0) for g in groups)),
        float(" " in s), float("." in s), float("," in s),
    ]


class Boosted:
    """Gradient-boosted trees of one depth for a probability: thresholds by quantile, Newton leaves."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.n, self.depth, self.rate, self.trees, self.bias = trees, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        p0 = (y.sum() + 1) / (len(y) + 2)
        self.bias = math.log(p0 / (1 - p0))
        score = np.full(len(y), self.bias)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            score += self._grow(tree, binned, y - p, p * (1 - p) + 1e-9, np.arange(len(y)), self.depth)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(g))
        me = len(tree)
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1)
        tree.append([-1, 0.0, value, 0, 0])
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f in range(binned.shape[1]):
                b, size = binned[rows, f], len(self.cuts[f]) + 1
                gl, hl = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
                if len(gl):
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
        if best[1] < 0:
            out[rows] = value
            return out
        _, f, k = best
        left = binned[rows, f] <= k
        tree[me][0], tree[me][1] = f, float(self.cuts[f][k])
        tree[me][3] = len(tree)
        out += self._grow(tree, binned, g, h, rows[left], depth - 1)
        tree[me][4] = len(tree)
        out += self._grow(tree, binned, g, h, rows[~left], depth - 1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            t = np.array([n[:2] for n in tree]), np.array([n[3:] for n in tree]), np.array([n[2] for n in tree])
            feature = t[0][:, 0].astype(int)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] > t[0][at, 1]
                at = np.where(inner, np.where(go, t[1][at, 1], t[1][at, 0]), at)
            score += t[2][at]
        return 1 / (1 + np.exp(-score))


def _examples(rnd: random.Random, n: int) -> Iterator[tuple[str, str, int, int, int]]:
    """Generated (text, kind, start, end, label): formats in public use, and look-alikes that are no personal data."""
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    mixed = lambda k, a="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789": "".join(rnd.choice(a) for _ in range(k))
    words = lambda k: " ".join(mixed(rnd.randint(2, 9), "abcdefghilmnoprstu") for _ in range(k))
    sep = lambda: rnd.choice([" ", "-", "."])

    def iban() -> str:
        body = "".join(rnd.choice("0123456789") for _ in range(rnd.choice([14, 16, 18, 20])))
        land = rnd.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rnd.random() < 0.5 else s

    for _ in range(n):
        kind, label = rnd.choice(EXTRA), rnd.randint(0, 1)
        cue = rnd.choice(_CUES[kind]) + rnd.choice([": ", " ", " = "]) if rnd.random() < (0.75 if label else 0.1) else ""
        if kind == "secret":
            value = rnd.choice([mixed(rnd.randint(16, 44)), mixed(rnd.choice([32, 40, 64]), "0123456789abcdef"), mixed(rnd.choice([64, 128, 256, 512]))]) if label else rnd.choice([mixed(rnd.randint(24, 40), "abcdefghilmnoprstu"), "_".join(mixed(rnd.randint(3, 7), "abcdefghilmnoprstu") for _ in range(5)), mixed(rnd.randint(24, 30), "AENRST")])
            cue = rnd.choice(["token", "secret", "api_key", "password"]) + rnd.choice([' = "', ": ", "="]) if label or rnd.random() < 0.05 else rnd.choice(["commit ", "sha256 ", "", "", ""])
            value = mixed(40, "0123456789abcdef") if cue in ("commit ", "sha256 ") else value
            if label and rnd.random() < 0.2:  # a long mixed run needs no keyword
                cue, value = "", mixed(rnd.choice([28, 36, 48, 64, 128, 256]))
        elif kind == "account":
            value = iban() if label else rnd.choice(["AB", "NO", "ID", "PO"]) + d(2) + rnd.choice(["", " "]).join(["", *[mixed(4, "0123456789ABCDEFGH") for _ in range(rnd.randint(2, 6))]]).strip()
        elif kind == "identity":
            value = rnd.choice([f"{d(3)}-{d(2)}-{d(4)}", mixed(1, "CFGHJKLMNPRTVWXYZ") + d(8)])
            cue = cue if label else rnd.choice(["order ", "version ", "page ", "isbn ", "build ", ""])
            cue = cue or (rnd.choice(["ssn ", "passport "]) if label else "")
        elif kind == "local_phone":
            s = sep()
            value = f"({d(3)}) {d(3)}-{d(4)}" if label and rnd.random() < 0.5 else f"{d(rnd.randint(3, 4))}{s}{d(3)}{s}{d(4)}" if label else rnd.choice([f"{d(4)}.{d(3)}.{d(3)}", f"{d(2)}.{d(4)} {d(4)}", f"{d(5)}/{d(3)}-{d(3)}"])
            cue = cue if label else rnd.choice(["version ", "price ", "total ", "build ", "", "rev "])
        else:
            local = rnd.choice([".", "_", ""]).join(mixed(rnd.randint(3, 8), "abcdeimnorst") for _ in range(rnd.choice([1, 1, 2, 3, 12, 25])))
            value = f"{local} {rnd.choice(['at', '[at]', '(at)'])} {mixed(rnd.randint(3, 12), 'abcdeimnorst')} {rnd.choice(['[dot]', '(dot)'])} {rnd.choice(['com', 'org', 'net'])}" if label else f"{mixed(3, 'abcdeimnorst')} at {mixed(4, 'abcdeimnorst')} (dot) {mixed(9, 'abcdeimnorst')}"
        text = f"{words(rnd.randint(0, 4))} {cue}"
        yield text + value + rnd.choice(["", '"', " ", ".", ", "]) + words(2), kind, len(text), len(text) + len(value), label


def _like_examples(rnd: random.Random, n: int) -> Iterator[tuple[str, str, int, int, int]]:
    """Generated look-alikes as in _examples: personal data with a slip or an unusual length, and numbers and handles that are none."""
    d = lambda k: rnd.choice("123456789") + "".join(rnd.choice("0123456789") for _ in range(k - 1))
    word = lambda a, b: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(a, b)))
    octet = lambda: str(rnd.randint(0, 255))
    for _ in range(n):
        kind, label = rnd.choice(LIKE), rnd.randint(0, 1)
        cue = rnd.choice(_CUES[kind]) + rnd.choice([": ", " ", " = "])
        none = rnd.choice(["version ", "order ", "build ", "total ", "", "", f"{word(3, 8)} "])
        bare = rnd.random() < 0.3  # a telling format needs no cue
        if kind == "email_like":
            a, b, c = word(3, 9), word(3, 9), rnd.choice(["com", "org", "net", "de", "fr"])
            value = rnd.choice([f"{a} @ {b}.{c}", f"{a}@{b} . {c}", f"{a}@{b},{c}", f"{a}.{word(3, 6)} @{b}.{c}"]) if label else rnd.choice([f"{a}@{b}", f"{a} @ {b}", f"{a}@{d(2)}", f"{a}@{b}, {word(3, 8)}"])
        elif kind == "ip_like":
            four = [octet(), octet(), octet(), octet()]
            four[rnd.randint(0, 3)] = str(rnd.randint(256, 999))
            bare = False
            value = ".".join(four) if label or rnd.random() < 0.3 else ".".join([d(1), d(rnd.randint(1, 2)), d(rnd.randint(1, 4)), d(rnd.randint(3, 5))])
        elif kind == "card_like":
            value = d(16)
            if label and rnd.random() < 0.6:
                value = rnd.choice(" -").join(value[i : i + 4] for i in range(0, 16, 4))
            else:
                bare = False
                value = d(rnd.choice([12, 13, 15, 16])) if label else rnd.choice([d(rnd.randint(12, 19)), f"20{d(2)}-0{d(1)}-1{d(1)} {d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)}"])
        else:
            s = rnd.choice(" -")
            if label and rnd.random() < 0.75:
                value = rnd.choice([f"+{d(3)}{s}{d(6)}", f"+{d(3)}{s}{d(5)}", f"+{d(2)}{s}{d(3)}{s}{d(4)}", f"+{d(3)}{s}{d(2)}{s}{d(2)}{s}{d(2)}"])
            else:
                bare = False
                value = f"+{d(rnd.randint(7, 9))}" if label else rnd.choice([f"+{d(rnd.randint(7, 9))}", f"+{d(1)}.{d(rnd.randint(6, 9))}", f"+{d(2)}.{d(3)}.{d(3)}", f"+{d(2)}.{d(5)}"])
        text = f"{word(2, 9)} {(none if bare else cue) if label else none}"
        yield text + value + rnd.choice(["", " ", ". ", "; "]) + rnd.choice(["", f"({word(2, 6)})"]), kind, len(text), len(text) + len(value), label


@lru_cache(maxsize=2)
def like_model(examples: int = EXAMPLES, seed: int = 21) -> tuple[Boosted, dict[str, float]]:
    """As model(), for look-alikes."""
    rnd = random.Random(seed)
    return _fitted([list(_like_examples(rnd, 2 * examples)) for _ in range(2)], LIKE, describe_like)


@lru_cache(maxsize=2)
def model(examples: int = EXAMPLES, seed: int = 20) -> tuple[Boosted, dict[str, float]]:
    """The trees and the threshold of each kind; the same on every call, wherever it runs."""
    rnd = random.Random(seed)
    return _fitted([list(_examples(rnd, 2 * examples)) for _ in range(2)], EXTRA, describe)


def _fitted(examples: list[list], kinds: tuple[str, ...], described) -> tuple[Boosted, dict[str, float]]:
    """Trees fitted on the first examples, and the threshold of each kind by the others."""
    (x, y), (hx, hy) = [(np.array([described(*r[:4]) for r in rows]), np.array([r[4] for r in rows], dtype=float)) for rows in examples]
    trees = Boosted().fit(x, y)
    p = trees.predict(hx)
    limits = {}
    for i, kind in enumerate(kinds):
        of = hx[:, 0] == i
        order = np.argsort(-p[of], kind="stable")
        precise = np.cumsum(hy[of][order]) / np.arange(1, of.sum() + 1) >= PRECISION
        limits[kind] = max(0.5, float(p[of][order][np.flatnonzero(precise)[-1]]) if precise.any() else 2.0)
    return trees, limits


def find(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the base ones, and those that the model selects beside them."""
    base = [base_spans(t) for t in texts]
    passed = [{s[1:] for s in spans} for spans in base]
    more: dict[int, list[tuple[float, str, int, int]]] = {}
    for (trees, limits), proposed, described in ((model(), candidates, describe), (like_model(), lookalikes, describe_like)):
        asked = [(i, *c) for i, t in enumerate(texts) if t for c in proposed(t) if proposed is candidates or c[1:] not in passed[i]]
        for at in range(0, len(asked), 4096):
            part = asked[at : at + 4096]
            p = trees.predict(np.array([described(texts[i], *c) for i, *c in part]))
            for (i, kind, a, b), q in zip(part, p, strict=True):
                if q >= limits[kind]:
                    more.setdefault(i, []).append((-float(q), kind, a, b))
    for i, found in more.items():
        taken = _union((a, b) for _, a, b in base[i])
        for _, kind, a, b in sorted(found):
            if _free(taken, a, b):
                base[i].append((kind, a, b))
        base[i].sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, as spans that do not meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether (a, b) meets none of the spans taken, which do not meet each other; if so it is taken."""
    at = bisect_left(taken, (a, b))
    if at < len(taken) and taken[at][0] < b or at and taken[at - 1][1] > a:
        return False
    taken.insert(at, (a, b))
    return True


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_spans(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """``df`` with all spans of each whole text: array<struct<kind, start, end, base>>, by start, then kind."""

    def make():
        def run(texts):
            return [[[{"kind": k, "start": a, "end": b, "base": k in BASE} for k, a, b in s] for s in find(texts)]]

        return run

    return append_columns(df, [text], make, f"{to} array<struct<kind:string,start:bigint,`end`:bigint,base:boolean>>")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced."""

    def make():
        def run(texts):
            return [[redacted(t, s) for t, s in zip(texts, find(texts), strict=True)]]

        return run

    order = df.columns
    return append_columns(df, [text], make, f"`{text}` string").select(*[F.col(f"`{c}`") for c in order])
