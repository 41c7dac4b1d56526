"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tags and text slots, a slot being the text of one block. The streams of a host's
pages are aligned one after the other to a union-free regular expression, its wrapper: where both agree,
the token stays and the slot's figures are pooled; where they do not, the tokens of either side become
optional groups; an element, or a run of tokens, that repeats the one before it becomes a repeated group.

The wrapper then decides, by its slots: those whose text differs between pages vary, the others belong to
the template. The content is the deepest element that holds nearly all varying text outside menus,
notices and the like; an ``article`` or ``main`` that holds as much is taken in place of one inside it, for
its heading. Short blocks outside lists, tables and quotes weigh less than their length, so a thread of
remarks beside a story doesn't move the content up. A page's text are the blocks within that element and, unless it is an ``article`` or
``main``, the headings and paragraphs that stand before it in the elements around it, or after it in its
parent; all without those of template slots: slots that every page of the host has, with the same text
(those of a story's own elements stay where pages are near copies, that is, where they share half as
much of such text as varies). A block that is nearly all links, outside paragraphs, headings, lists and tables, is set aside. Names say only what is set aside from the start: elements such as ``nav`` and ``footer``, and those
whose class, id or role consists of such words alone; of ``related-work`` the wrapper decides.

All pages count. Equal streams of a host are pooled before anything is grouped (sums, least and
greatest digest for each slot); streams are then aligned in groups, as many as the host's number and size
of streams ask for, and the figures of elements and template slots are added up over the groups by Spark. So a
host with a third of all pages neither meets in one task nor is sampled. Where layouts differ so much
that an expression would grow beyond ``LONGEST`` tokens, a group has several.

Null and empty html gives the empty string; a null url or one without a host shares the wrapper of
the empty host. A page without its wrapper's element is read by its own stream. Of elements that tie, the
last by name is the content; repeated rows each get their result; an empty table gives no rows; a column
that bears the result's name is replaced, all others stay. Very long pages are read whole.
"""

from __future__ import annotations

import difflib
import html
import json
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.columns import append_columns, quoted, small, written

#: Distinct streams, and their bytes, that are aligned as one group; tokens of the longest repeated run of several elements; pairs of tokens that are aligned as one segment.
STREAMS, STREAM_BYTES, LONGEST_GROUP, SEGMENT = 256, 8 << 20, 12, 640_000
#: Tokens of an expression, beyond which a group gets another one beside it.
LONGEST = 1600
BROADCAST_ROWS = 50_000
#: The content element holds this share of the varying text.
SHARE = 0.8
#: Characters from which a block counts in full, and the share of a block's characters beyond which it is a link.
FULL, LINKS = 120, 0.8
#: Pages that a host must have before a text that they share counts as template.
LEAST_PAGES = 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ASIDE = frozenset("nav footer aside form head script style noscript iframe svg button select textarea dialog menu object canvas template title input math audio video".split())
_HINTS = frozenset("ad ads adv advert advertisement advertising banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies notice consent popup modal newsletter subscribe share sharing social related comment comments disqus reply replies pagination pager toolbar".split())
#: Words that go with those above in a name without changing what it says.
_PARTS = frozenset("list box wrap wrapper container block section area widget inner outer item items link links bar button buttons slot unit top bottom left right main page site global primary secondary header title text posts post article articles form icon icons row col column group panel module thread count holder frame zone label content text js mobile desktop sticky fixed".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose short texts count in full.
_ITEM = frozenset("li dt dd td th caption figcaption pre blockquote".split())
#: Elements of a story: a lead beside the content stands in a heading or paragraph, and near copies share the texts of all of them.
_LEAD = _HEADINGS | {"p"}
_STORY = _LEAD | _ITEM
_MARKUP = re.compile(r"<(?:!--(?:[^-]|-(?!->))*+(?:-->|\Z)|!\[CDATA\[|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z))")
_NAMED = re.compile(r"""(?i)(?:\s|^)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_PIECES = re.compile(r"[^a-z0-9]+")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", name, attributes or text) of a page; raw elements are opened and closed without their content."""
    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or m[6] or ""
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            yield "close", name, ""


def hinted(value: str) -> bool:
    """Whether one of the names in a class, id or role says by all its words that the element is set aside."""
    for name in value.lower().split():
        words = [w for w in _PIECES.split(name) if w and not w.isdigit()]
        if not _HINTS.isdisjoint(words) and all(w in _HINTS or w in _PARTS for w in words):
            return True
    return False


def labelled(name: str, attributes: str) -> tuple[str, bool]:
    """The label of an element (name and first class or id), and whether it is set aside by name or by class, id or role."""
    aside, label = name in _ASIDE, name
    if attributes and "=" in attributes:
        for kind, a, b, c in _NAMED.findall(attributes):
            value = a or b or c
            words = value.lower().split()
            if words and label == name and kind.lower() != "role":
                label = f"{name}.{words[0]}"
            if name not in ("body", "html", "main", "article") and hinted(value):
                aside = True
    return label, aside


def walk(page: str) -> Iterator[tuple[str, str, bool]]:
    """("open" | "close", label, set aside) of block elements and ("text" | "link", text, set aside), properly nested.

    An end tag closes what is open inside its element; one that has no open element is passed over; a
    block ends an open paragraph; inline elements give white space at ``br`` and otherwise nothing, but
    the text of one that is set aside by class, id or role is set aside.
    """
    stack: list[tuple[str, str, bool, str]] = []  # name, label, set aside, and the nearest element around that is an article, a header or the like
    names: Counter[str] = Counter()
    links = 0
    muted, within, since = "", 0, 0  # the inline element that is set aside, how many of its name are open, and the blocks around it

    def closed() -> tuple[str, str, bool]:
        name, label, aside, _ = stack.pop()
        names[name] -= 1
        return "close", label, aside

    for kind, name, rest in events(page):
        if kind == "text":
            yield "link" if links else "text", rest, bool(muted) or bool(stack) and stack[-1][2]
        elif name in _INLINE:
            if name == "a":
                links = 1 if kind == "open" else 0  # links do not nest
            if name == "br":
                yield "text", " ", bool(muted) or bool(stack) and stack[-1][2]
            elif name not in _VOID:
                if muted:
                    if name == muted:
                        within += 1 if kind == "open" else -1
                        muted = muted if within else ""
                elif kind == "open" and "=" in rest and any(hinted(a or b or c) for _, a, b, c in _NAMED.findall(rest)):
                    muted, within, since = name, 1, len(stack)
        elif kind == "open":
            while stack and stack[-1][0] == "p" or stack and name == stack[-1][0] and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                yield closed()
            label, aside = labelled(name, rest)
            outer, nearest = (stack[-1][2], stack[-1][3]) if stack else (False, "")
            inside = outer or aside or name == "header" or name in _VOID
            if outer and name in _HEADINGS and nearest == "header" and (names["article"] or names["main"]):
                inside = False  # an article's own heading stands in its header
            yield "open", label, inside
            if name in _VOID:
                yield "close", label, inside
            else:
                stack.append((name, label, inside, name if name in _ASIDE or name in ("header", "article", "main") else nearest))
                names[name] += 1
        elif names[name]:
            while True:
                last = stack[-1][0]
                yield closed()
                if last == name:
                    break
        if muted and len(stack) < since:
            muted = ""
    while stack:
        yield closed()


def blocks(page: str) -> Iterator[tuple[str, str, bool]]:
    """As ``walk``, but the text between two tags of blocks is one, with references decoded and white space made single; what is set aside in it counts only where there is nothing else."""
    now: list[str] = []
    aside: list[str] = []
    around: list[str] = []
    linked = plain = 0

    def text(parts: list[str]) -> str:
        return " ".join(html.unescape("".join(parts)).split())

    for kind, what, skip in walk(page):
        if kind in ("text", "link"):
            (aside if skip else now).append(what)
            if not skip and kind == "link":
                linked += len(what)
            elif not skip:
                plain += len(what.strip())
            continue
        if now and (found := text(now)):
            yield "text", found, linked > LINKS * (linked + plain) and (around[-1].split(".")[0] if around else "") not in _STORY
        elif aside and (found := text(aside)):
            yield "text", found, True
        now, aside, linked, plain = [], [], 0, 0
        if kind == "open":
            around.append(what)
        elif around:
            around.pop()
        yield kind, what, skip
    if found := text(now):
        yield "text", found, False


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def weight(text: str, label: str) -> int:
    """What a text counts for: its characters, or less where it is a short block outside a list, table or quote."""
    n = len(text)
    return n if label.split(".")[0] in _ITEM else max(1, min(n, n * n // FULL))


def _mixed(a: int, b: int) -> int:
    return (a * 0x9E3779B97F4A7C15 + b) & 0x7FFFFFFFFFFFFFFF


class Wrapper:
    """A union-free expression: tokens, which of them are optional, the ends of repeated groups, and a slot's figures.

    A token is "<label", ">label" or "#" (a slot); a slot has [pages, weight in characters, least digest, greatest
    digest] of its texts outside elements set aside (zero characters inside them). The digest of a page's
    repeated group goes over all its texts, in order. ``pages`` says how many pages the expression is of.
    A single page's wrapper also knows the numbers of the texts in each slot.
    """

    __slots__ = ("figures", "optional", "pages", "repeat", "starts", "texts", "tokens")

    def __init__(self, tokens, optional, repeat, figures, pages=1):
        self.tokens, self.optional, self.repeat, self.figures, self.pages = tokens, optional, repeat, figures, pages
        self.texts: list[list[int]] = [[] for _ in tokens]
        self.starts: list[int] = []

    @classmethod
    def of_page(cls, page: str) -> Wrapper:
        w, n = cls([], [], [], []), 0
        around: list[str] = []
        for kind, what, aside in blocks(page):
            if kind != "text":
                w._add(("<" if kind == "open" else ">") + what, None)
                if kind == "open":
                    around.append(what)
                else:
                    around.pop()
            else:
                h = _digest(what)
                w._add("#", [1, 0 if aside else weight(what, around[-1] if around else ""), h, h], texts=[n])
                n += 1
        return w

    def _add(self, token: str, figure: list | None, optional: bool = False, repeat: int = 0, texts: Iterable[int] = ()) -> None:
        tokens = self.tokens
        if token == "#" and tokens and tokens[-1] == "#":
            self._pool(len(tokens) - 1, figure)
            self.texts[-1].extend(texts)
            return
        tokens.append(token)
        self.optional.append(optional)
        self.repeat.append(repeat)
        self.figures.append(figure)
        self.texts.append(list(texts))
        n = len(tokens)
        if token[0] == "<":
            self.starts.append(n - 1)
        elif token[0] == ">":
            start = self.starts.pop() if self.starts else 0
            k = n - start  # an element that repeats the one before it, however long
            if start >= k > LONGEST_GROUP and tokens[start - 1] == token and tokens[start][1:] == token[1:] and tokens[start - k : start] == tokens[start:]:
                return self._fold(k)
        for k in range(1, min(LONGEST_GROUP, n // 2) + 1):  # a run that repeats the run before it becomes one group
            if tokens[-1] == tokens[-1 - k] and tokens[n - k :] == tokens[n - 2 * k : n - k] and _balanced(tokens[n - k :]):
                return self._fold(k)

    def _fold(self, k: int) -> None:
        """The last ``k`` tokens go into the ``k`` before them."""
        n = len(self.tokens)
        for i in range(n - k, n):
            self.optional[i - k] = self.optional[i - k] and self.optional[i]
            self._pool(i - k, self.figures[i])
            self.texts[i - k].extend(self.texts[i])
        for x in (self.tokens, self.optional, self.repeat, self.figures, self.texts):
            del x[n - k :]
        self.repeat[-1] = max(self.repeat[-1], k)

    def _pool(self, at: int, figure: list | None) -> None:
        """Add the figures of a text of the same pages."""
        mine = self.figures[at]
        if mine is None or figure is None:
            self.figures[at] = mine or figure
        else:
            self.figures[at] = [max(mine[0], figure[0]), mine[1] + figure[1], _mixed(mine[2], figure[2]), _mixed(mine[3], figure[3])]

    def key(self) -> str:
        return " ".join(f"{t}{'+' * (r > 0)}{r or ''}" for t, r in zip(self.tokens, self.repeat, strict=True))

    def align(self, other: Wrapper) -> Wrapper:
        """The expression that both fit: agreed tokens, and optional groups of what only one of them has."""
        out = Wrapper([], [], [], [], self.pages + other.pages)
        for op, a, b, c, d in _opcodes(self.tokens, other.tokens):
            if op == "equal":
                for i, j in zip(range(a, b), range(c, d), strict=True):
                    x, y = self.figures[i], other.figures[j]
                    pooled = [x[0] + y[0], x[1] + y[1], min(x[2], y[2]), max(x[3], y[3])] if x and y else x or y
                    out._add(self.tokens[i], pooled, self.optional[i] or other.optional[j], max(self.repeat[i], other.repeat[j]))
            else:
                for w, at, to in ((self, a, b), (other, c, d)):
                    for i in range(at, to):
                        out._add(w.tokens[i], w.figures[i], True, w.repeat[i])
        return out

    def content(self) -> str | None:
        """The label of the element that holds nearly all varying text, or None if there is no text."""
        return content_of([self])

    def slots(self) -> Iterator[tuple[int, str]]:
        """(place, label of the element around it) of each slot."""
        stack: list[str] = []
        for i, token in enumerate(self.tokens):
            if token[0] == "<":
                stack.append(token[1:])
            elif token[0] == ">":
                if token[1:] in stack:
                    while stack.pop() != token[1:]:
                        pass
            else:
                yield i, stack[-1] if stack else ""

    def same(self) -> Iterator[tuple[str, int, int]]:
        """(label, digest, weight on all pages) of each slot whose text is the same on all pages of the expression."""
        for i, label in self.slots():
            f = self.figures[i]
            if f and f[1] and f[0] == self.pages and f[2] == f[3]:
                yield label, f[2], f[1]

    def elements(self, fixed: frozenset[int] | set[int] = frozenset()) -> list[tuple[str, int, int]]:
        """(label, depth, characters of varying text) of each element. Where no slot varies all text counts, but for the texts ``fixed``."""
        varying = any(f and f[1] and f[2] != f[3] for f in self.figures)
        stack: list[list] = []
        names: Counter[str] = Counter()
        done: list[tuple[str, int, int]] = []

        def closed() -> str:
            label, chars = stack.pop()
            names[label] -= 1
            done.append((label, len(stack), chars))
            if stack:
                stack[-1][1] += chars
            return label

        for token, f in zip(self.tokens, self.figures, strict=True):
            if token[0] == "<":
                stack.append([token[1:], 0])
                names[token[1:]] += 1
            elif token[0] == ">":
                while names[token[1:]] and closed() != token[1:]:
                    pass
            elif stack and f and (f[2] != f[3] or not varying and f[2] not in fixed):
                stack[-1][1] += f[1]
        while stack:
            closed()
        return done


#: Elements that hold pieces of a story, never the whole.
_PIECE = frozenset(("ul", "ol", "dl", "tr", "table", "tbody", "thead", "figure", *_STORY))


def shares(wrappers: list[Wrapper]) -> tuple[int, dict[str, list]]:
    """The varying text of a host's expressions, and for each label [characters of all its elements, those of its deepest element that holds an expression's varying text (or else its largest), their depths times these characters]."""
    seen = Counter(h for w in wrappers for h in {f[2] for f in w.figures if f and f[1] and f[2] == f[3]})
    fixed = {h for h, n in seen.items() if n > 1}
    sums: dict[str, list] = defaultdict(lambda: [0, 0, 0])
    whole = 0
    for w in wrappers:
        done = w.elements(fixed)
        top = max((chars for _, depth, chars in done if depth == 0), default=0)
        best: dict[str, tuple[bool, int, int]] = {}
        for label, depth, chars in done:
            sums[label][0] += chars
            full = chars >= SHARE * top
            best[label] = max(best.get(label, (False, 0, 0)), (full, depth, chars) if full else (full, chars, depth))
        for label, (full, x, y) in best.items():
            depth, chars = (x, y) if full else (y, x)
            sums[label][1] += chars
            sums[label][2] += depth * chars
        whole += top
    return whole, sums


def content_of(wrappers: list[Wrapper]) -> str | None:
    """The label of the element that holds nearly all varying text of a host's expressions: the deepest, or an article or main that holds as much."""
    whole, sums = shares(wrappers)
    good = {x: v for x, v in sums.items() if v[1] and v[1] >= SHARE * whole and x.split(".")[0] not in _PIECE}
    for wanted in ("article", "main"):
        if found := [x for x in good if x.split(".")[0] == wanted]:
            return max(found, key=lambda x: (good[x][0], x))
    return max(good, key=lambda x: (good[x][2] / good[x][1], good[x][1], x)) if good else None


def joined(parts: Iterable[Wrapper]) -> list[Wrapper]:
    """Expressions that fit all parts: each part is aligned with the expression before it, but begins one of its own where the two would be longer than LONGEST and four times the part."""
    out: list[Wrapper] = []
    for w in parts:
        both = out[-1].align(w) if out else w
        if out and len(both.tokens) > max(LONGEST, 4 * len(w.tokens)):
            out.append(w)
        else:
            out[-1:] = [both]
    return out


def _opcodes(a: list[str], b: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """What makes ``b`` of ``a``, as difflib gives it, segment by segment."""
    for a0, a1, b0, b1 in _segments(a, b):
        for op, i, j, k, m in difflib.SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_opcodes():
            yield op, a0 + i, a0 + j, b0 + k, b0 + m


def _segments(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches that cover both streams whole, of at most SEGMENT pairs of tokens: long streams are cut before tokens that either has once, in the longest order they share, then evenly."""
    cuts = [(0, 0)]
    if len(a) * len(b) > SEGMENT:
        in_a, in_b = Counter(a), Counter(b)
        place = {t: j for j, t in enumerate(b) if in_b[t] == 1}
        pairs = [(i, place[t]) for i, t in enumerate(a) if in_a[t] == 1 and t in place]
        least: list[int] = []  # the least place in b that ends an order of each length, its pair, and the pair before each pair
        last: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(pairs):
            n = bisect_left(least, j)
            before.append(last[n - 1] if n else -1)
            least[n : n + 1], last[n : n + 1] = [j], [k]
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        cuts += reversed(chain)
    for (a0, b0), (a1, b1) in pairwise([*cuts, (len(a), len(b))]):
        n = max(1, math.ceil(math.sqrt((a1 - a0) * (b1 - b0) / SEGMENT)))
        for k in range(n):
            yield a0 + (a1 - a0) * k // n, a0 + (a1 - a0) * (k + 1) // n, b0 + (b1 - b0) * k // n, b0 + (b1 - b0) * (k + 1) // n


def _balanced(tokens: list[str]) -> bool:
    depth = 0
    for t in tokens:
        depth += (t[0] == "<") - (t[0] == ">")
        if depth < 0:
            return False
    return depth == 0


def main_text(page: str | None, content: str | None, template: Iterable[tuple[str, int]] = ()) -> str:
    """The blocks within the element ``content`` of a page, without those of the slots ``template`` (label, digest), joined by line ends."""
    if not page:
        return ""
    tokens = list(blocks(page))
    own = None
    if content is None or not any(k == "open" and t == content for k, t, _ in tokens):
        own = Wrapper.of_page(page)
        content = own.content()
    dropped: set[int] = set()
    if template := set(template):
        own = own or Wrapper.of_page(page)
        dropped = {n for i, label in own.slots() if own.figures[i] and (label, own.figures[i][2]) in template for n in own.texts[i]}
    depth, out, n = (0 if content else 1), [], 0
    leads = bool(content) and content.split(".")[0] not in ("article", "main")
    stack: list[list] = []  # label, headings and paragraphs so far, whether the content was in it
    for kind, what, aside in tokens:
        if kind == "text":
            if not aside and n not in dropped:
                if depth:
                    out.append(what)
                elif leads and len(stack) > 1 and stack[-1][0].split(".")[0] in _LEAD:
                    label, before, after = stack[-2]
                    (out if after and label.split(".")[0] not in ("body", "html") else before).append(what)
            n += 1
            continue
        if kind == "open":
            if what == content and not depth:
                for frame in stack:
                    out += frame[1]
                    frame[1] = []
                if stack:
                    stack[-1][2] = True
            stack.append([what, [], False])
        else:
            stack.pop()
        if what == content:
            depth += 1 if kind == "open" else -1
    return "\n".join(out)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)), F.lit(""))


def streams(df: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """(host, k, pages, stream, slots): the distinct streams of each host, with the figures of their slots over all pages."""

    def make():
        def run(pages):
            found = [Wrapper.of_page(p) if p else None for p in pages]
            rows = [[{"slot": -1, "chars": 0, "digest": 0, "stream": json.dumps([w.tokens, w.repeat])}, *({"slot": i, "chars": f[1], "digest": f[2], "stream": None} for i, f in enumerate(w.figures) if f)] if w else [] for w in found]
            return [[w and xxhash.xxh3_128_hexdigest(w.key()) for w in found], rows]

        return run

    pages = df.select(host(F.col(quoted(url))).alias("host"), F.col(quoted(html_column)).alias("page"))
    each = append_columns(pages, ["page"], make, "k string, slots array<struct<slot:int,chars:bigint,digest:bigint,stream:string>>").drop("page").where("k is not null")
    # the stream itself stands beside the slot -1 only, so it is not copied for every slot
    slots = each.select("host", "k", F.inline("slots")).groupBy("host", "k", "slot").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.max("stream").alias("stream"))
    shape = F.struct("slot", "n", "chars", "least", "most")
    return slots.groupBy("host", "k").agg(F.max(F.when(F.col("slot") < 0, F.col("n"))).alias("pages"), F.max("stream").alias("stream"), F.collect_list(F.when(F.col("slot") >= 0, shape)).alias("slots"))


def wrappers(df: DataFrame, html_column: str = "html", url: str = "url", most: int = STREAMS) -> DataFrame:
    """(host, kind, label, pages, chars, held, depths, digest): what the wrappers of each group of a host's streams say.

    Characters are weights (``weight``). Of kind "group" with its pages, its varying text and (held) whether any slot varies, of kind "element" with the figures of ``shares``,
    of kind "same" with a slot whose text is the same on all the group's pages.
    """
    pooled = written(streams(df, html_column, url))
    sizes = written(pooled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("stream")).alias("bytes")).select("host", F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("bytes") / STREAM_BYTES)).cast("int").alias("groups")))
    salted = pooled.join(F.broadcast(sizes) if small(sizes, BROADCAST_ROWS) else sizes, "host").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("groups"))).drop("groups")

    def group(table: pa.Table) -> pa.Table:
        def each() -> Iterator[Wrapper]:
            for r in sorted(table.select(["stream", "slots", "pages"]).to_pylist(), key=lambda r: r["stream"]):
                tokens, repeat = json.loads(r["stream"])
                figures: list = [None] * len(tokens)
                for s in r["slots"]:
                    figures[s["slot"]] = [s["n"], s["chars"], s["least"], s["most"]]
                yield Wrapper(tokens, [False] * len(tokens), repeat, figures, r["pages"])

        found = joined(each())
        pages = sum(w.pages for w in found)
        whole, sums = shares(found)
        varies = any(f and f[1] and f[2] != f[3] for w in found for f in w.figures)
        rows = [("group", "", pages, whole, int(varies), 0, 0)] + [("element", x, 0, *v, 0) for x, v in sums.items()]
        same: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
        for w in found:
            for label, digest, chars in {x[:2]: x for x in w.same()}.values():
                same[label, digest][0] += w.pages
                same[label, digest][1] += chars
        rows += [("same", label, n, chars, 0, 0, digest) for (label, digest), (n, chars) in same.items()]
        columns = list(zip(*rows, strict=True))
        names = ["kind", "label", "pages", "chars", "held", "depths", "digest"]
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(rows), pa.string())} | {x: pa.array(c, pa.string() if x in ("kind", "label") else pa.int64()) for x, c in zip(names, columns, strict=True)})

    return salted.groupBy("host", "salt").applyInArrow(group, "host string, kind string, label string, pages bigint, chars bigint, held bigint, depths bigint, digest bigint")


def decided(found: DataFrame) -> DataFrame:
    """(host, content, template) of each host, from what its groups say: the label of its content element, and its template slots (no more than a page has)."""
    hosts = found.where("kind = 'group'").groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("whole"), F.max("held").alias("varies"))
    name = F.substring_index("label", ".", 1)
    sums = found.where("kind = 'element'").groupBy("host", "label").agg(F.sum("chars").alias("chars"), F.sum("held").alias("held"), F.sum("depths").alias("depths"))
    good = sums.join(hosts, "host").where((F.col("held") > 0) & (F.col("held") >= SHARE * F.col("whole")) & ~name.isin(*sorted(_PIECE)))
    holder = F.when(name == "article", 2).when(name == "main", 1)
    best = good.groupBy("host").agg(
        F.max_by("label", F.when(holder > 0, F.struct(holder.alias("a"), F.col("chars").alias("b"), F.col("label").alias("c")))).alias("holder"),
        F.max_by("label", F.struct((F.col("depths") / F.col("held")).alias("a"), F.col("held").alias("b"), F.col("label").alias("c"))).alias("deepest"),
    )
    same = found.where("kind = 'same'").groupBy("host", "label", "digest").agg(F.sum("pages").alias("n"), F.sum("chars").alias("chars"))
    # where nothing varies, all pages are copies, and there is no telling a template
    shared = same.join(hosts.where("varies > 0"), "host").where((F.col("n") == F.col("pages")) & (F.col("pages") >= LEAST_PAGES))
    story, slot = name.isin(*sorted(_STORY)), F.struct("label", "digest")
    by = shared.groupBy("host").agg(F.max("whole").alias("whole"), F.sum(F.when(story, F.col("chars")).otherwise(0)).alias("own"), F.collect_list(slot).alias("every"), F.collect_list(F.when(~story, slot)).alias("others"))
    # near copies share most of their story: its texts are no template there
    template = by.select("host", F.when(F.col("own") * 2 >= F.col("whole"), F.col("others")).otherwise(F.col("every")).alias("template"))
    return hosts.select("host").join(best.select("host", F.coalesce("holder", "deepest").alias("content")), "host", "left").join(template, "host", "left")


def extract(df: DataFrame, html_column: str = "html", url: str = "url", to: str = "text") -> DataFrame:
    """``df`` with the main text of each page; the html column stays."""
    found = written(decided(written(wrappers(df, html_column, url))))
    names = [f"c{i}" for i in range(len(df.columns))]
    given = df.toDF(*names).withColumn("at", host(F.col(names[df.columns.index(url)])))
    rows = given.join(F.broadcast(found) if small(found, BROADCAST_ROWS) else found, F.col("at") == found.host, "left").drop("at", "host")

    def make():
        def run(pages, contents, templates):
            return [[main_text(p, c, [(x["label"], x["digest"]) for x in t or ()]) for p, c, t in zip(pages, contents, templates, strict=True)]]

        return run

    out = append_columns(rows, [names[df.columns.index(html_column)], "content", "template"], make, "result string").drop("content", "template")
    kept = [(x, c) for x, c in zip(names, df.columns, strict=True) if c.lower() != to.lower()]
    return out.select(*[x for x, _ in kept], "result").toDF(*[c for _, c in kept], to)
