"""Main text of pages without telling names: leads, lists, threads of remarks, adverts, notices."""

import random

import pytest

from granary.llm import html_wrappers

_R = random.Random(5)
_WORDS = "alpha beta gamma delta omega lorem ipsum dolor stone river cloud".split()


def _words(n):
    return " ".join(_R.choice(_WORDS) for _ in range(n))


def _story(i):
    return [f"Title {i}", f"Lead {i} {_words(8)}", *[_words(n) for n in (40, 60, 50)]]


def _paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


SHAPES = {
    "heading and lead before the story's element": lambda s, i: f"<div class=top>Site</div><div><h1>{s[0]}</h1><p>{s[1]}</p><div class=b>{_paragraphs(s[2:])}</div></div><div class=z>Copyright</div>",
    "a paragraph after it": lambda s, i: f"<div><h1>{s[0]}</h1><div class=b>{_paragraphs(s[1:4])}</div><p>{s[4]}</p></div><div class=z>Copyright</div>",
    "a list": lambda s, i: f"<div class=x><h1>{s[0]}</h1><p>{s[1]}</p><ul>{''.join(f'<li>{t}</li>' for t in s[2:])}</ul></div>",
    "a thread of remarks, a footer's paragraph": lambda s, i: f"<div class=s><h1>{s[0]}</h1>{_paragraphs(s[1:])}</div><div class=c7>{_paragraphs(f'Remark {_words(8)}' for _ in range(i + 3))}</div><p>Footer</p>",
    "an advert of links, a notice before the story": lambda s, i: f"<div class=s><p>We use things</p><h1>{s[0]}</h1>{_paragraphs(s[1:3])}<div class=q5><a href=x>Advert {_words(5)}</a></div>{_paragraphs(s[3:])}</div>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    stories = [_story(i) for i in range(8)]
    pages = [(i, f"http://h/{i}", f"<html><body>{SHAPES[shape](s, i)}</body></html>") for i, s in enumerate(stories)]
    rows = html_wrappers.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: "\n".join(s) for i, s in enumerate(stories)}


def test_texts_of_near_copies_stay(spark):
    shared = [_words(50) for _ in range(4)]
    pages = [(i, "http://h/", f"<body><div class=s><h1>Copy {i}</h1>{_paragraphs(shared[:2])}<pre>{shared[2]}</pre><blockquote>{shared[3]}</blockquote></div></body>") for i in range(5)]
    rows = html_wrappers.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: "\n".join([f"Copy {i}", *shared]) for i in range(5)}


def test_one_page_and_links_within_text(spark):
    page = "<body><div><p>See <a href=x>this</a> and that</p><ul><li><a href=y>An item of links</a></li></ul><div><a href=z>More</a></div></div></body>"
    rows = html_wrappers.extract(spark.createDataFrame([(1, "http://h/", page), (2, None, None), (3, "", "")], "page_id int, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {1: "See this and that\nAn item of links", 2: "", 3: ""}
