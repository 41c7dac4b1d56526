"""Web pages and office documents: HTML to Markdown, headings, links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

_SKIP = {"script", "style", "noscript", "template"}
_HEAD = {"head", "title", "meta", "link", "base", *_SKIP}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "tr", "form", "blockquote", "ul", "ol", "dl", "figure"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.head = False
        self.lists: list[list] = []
        self.hrefs: list[str | None] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        if self.head and tag not in _HEAD:
            self.head = False  # the end tag of the head may be left out
        if tag == "head":
            self.head = True
        elif tag in _SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            level = max(0, len(self.lists) - 1)
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self.out.append("\n" + "  " * level + mark + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href"))
            self.out.append("[" if self.hrefs[-1] else "")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.hrefs:
            href = self.hrefs.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in _BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip and not self.head:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    """A page as Markdown: headings, lists, emphasis, code, links and images; scripts, styles and comments go."""
    if not html:
        return ""
    p = _Markdown()
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_to_markdown(df: DataFrame, html: str = "html", to: str = "markdown") -> DataFrame:
    @F.pandas_udf("string")
    def convert(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in pages:
            yield p.map(markdown_of)

    return df.withColumn(to, convert(html))


def page_headings(df: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key…, n, level, title, anchor) of a page's headings, tags inside them dropped."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>"), F.lit(0))
    rows = df.select(*key, F.posexplode(tags).alias("n", "tag"))
    title = F.trim(F.regexp_replace(F.regexp_replace("tag", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return rows.select(*key, F.col("n").cast("bigint").alias("n"), F.regexp_extract("tag", r"(?i)^<h([1-6])", 1).cast("bigint").alias("level"), title.alias("title"), T.anchor(title).alias("anchor"))


def page_sections(df: DataFrame, key: list[str], anchors: list[str], html: str = "html") -> DataFrame:
    """(key…, n, anchor, title, content): the sections of each page's Markdown with these anchors, in their order."""
    from granary.sources import extract

    marked = html_to_markdown(df.select(*key, html), html)
    return extract.rows_of(marked, key, "markdown", extract.sections(anchors), extract.SECTIONS).where("error is null").drop("error")


def page_links(df: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key…, href): each link of a page once."""
    hrefs = F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1)))
    return df.select(*key, F.explode(hrefs).alias("href"))


def heading_rule(line: Column) -> Column:
    """A line of under sixty bytes without lower-case letters is a heading of a converted document."""
    bare = F.trim(line)
    return (F.octet_length(bare) < 60) & bare.rlike(r"^[\p{Lu}\s]+$") & bare.rlike(r"\p{Lu}")


_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_markdown(content: bytes | None) -> str | None:
    """A DOCX document as Markdown: three levels of headings, paragraphs; None where it cannot be read."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    if not content:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    out = []
    for p in body.iter(f"{_DOCX}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_DOCX}t")).strip()
        style = p.find(f"{_DOCX}pPr/{_DOCX}pStyle")
        m = re.fullmatch(r"Heading([1-3])", style.get(f"{_DOCX}val") or "") if style is not None else None
        if text:
            out.append("#" * int(m[1]) + " " + text if m else text)
    return "\n\n".join(out)


_PDF_TEXT = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s()<>\[\]/]+|/[^\s()<>\[\]/]*")
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1])
        raw = re.sub(rb"(?s)\\([0-7]{1,3}|.)", octal, token[1:-1])
    return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def pdf_lines(content: bytes) -> list[str]:
    """The lines of text that a PDF's pages show, in the order of its content streams; fonts with tables of their own are read by their plain codes."""
    import zlib

    out: list[str] = []
    for m in re.finditer(rb"(?s)<<((?:[^<>]|<[^<]|>[^>]|<<.*?>>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", content):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data:
            continue
        line, last, strings = "", b"", []
        for token in _PDF_TEXT.findall(data):
            if token[:1] in (b"(", b"<"):
                strings.append(_pdf_string(token))
            elif token in (b"Tj", b"TJ"):
                line += "".join(strings)
                strings = []
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET"):
                if token in (b"'", b'"'):
                    out.append(line)
                    line = "".join(strings)
                elif line and not (token == b"Td" and last == b"0"):
                    out.append(line)
                    line = ""
                strings = []
            last = token
        out.append(line)
    return [x.strip() for x in out if x.strip()]


def pdf_markdown(content: bytes | None) -> str | None:
    """A PDF as Markdown: lines of under sixty bytes without lower-case letters are headings; None where it is no PDF."""
    if not content or not content[:1024].lstrip().startswith(b"%PDF"):
        return None
    heading = lambda x: len(x.encode()) < 60 and all(c.isupper() or c.isspace() for c in x)
    return "\n\n".join(f"## {x}" if heading(x) else x for x in pdf_lines(content))


def convert_documents(files: DataFrame, content: str = "content", to: str = "markdown") -> DataFrame:
    """Binary files with their Markdown; null where a file is no readable document."""

    @F.pandas_udf("string")
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda b: pdf_markdown(bytes(b)) or docx_markdown(bytes(b)) if b is not None else None)

    return files.withColumn(to, convert(content))
