"""HTML extraction: spans, visibility, broken markup in linear time, and a plainer reader of visible text as brute force."""

import hashlib
import html.parser
import random
import re
import time

import pytest

from quillmesh.llm.common import setup, table
from quillmesh.llm.html_text import extract, page_texts

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
        ("<table><tr><td>x<td rowspan=2>long one<td>y<tr><td>1<td>2<tr><td>3<td>4<td>5</table>", "x | long one | y\n1 |          | 2\n3 | 4        | 5"),
        ("<table><tr><td rowspan=0>all<td>1<tr><td>2<tr><td>3</table>", "all | 1\n    | 2\n    | 3"),
        ("<table><tr><td colspan=90>wide<td>z<tr><td>a</table>", "wide | z\na"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
        ("<p style='visibility:visible'>a<span style='visibility:collapse'>no</span>b", "ab"),
        ("<a href=\"x>never closed", "never closed"),
        ("<a title='1' title=2 hidden>no</a>yes", "yes"),
        ("<ul><li><ul><li>in</ul><li></ul>", "- - in\n-"),
        ("<blockquote><p>a<p>b</blockquote>c", "> a\n>\n> b\n\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<table><caption>c</caption><tr><td>a</table>after", "c\na\n\nafter"),
    ],
)
def test_layout(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 300_000 + '"',
        "<a b='" * 150_000,
        '<a b="c" ' * 120_000,
        "<br>" * 250_000,
        " <br>\n" * 150_000,
        "<div>" * 100_000 + "</span>" * 60_000,
        "<div>x" * 150_000,
        "<li>x" * 200_000,
        "<ul><li>x" * 100_000,
        "<blockquote>x" * 70_000,
        "<p><b>" * 150_000,
        "<table><tr><td>" * 60_000 + "x",
        "<table><tr><td>x" * 60_000,
        "<table><tr><td>a<td>x" * 45_000,
        "<table><tbody><tr><th>h<td><ul><li>q" * 25_000,
        "<table>" + "<tr><td rowspan=60000>a" * 40_000,
        "<table><tr>" + "<td rowspan=65000>a" * 25_000 + "<tr><td>x" * 50_000,
        "<table>" + "<tr><td colspan=99>a<td>b" * 40_000,
        "<table><tr><td>" + "w" * 400_000 + "<td>z" + "<tr><td>a<td>b" * 40_000,
        "&" * 1_000_000,
        "<" * 1_000_000,
        "<!--" * 250_000,
        "<![CDATA[" * 100_000,
        "<script>" * 120_000,
        "<x " + "y=1 " * 250_000,
        "</" * 500_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    text = extract(page)
    assert time.process_time() - began < 12 and len(text) < 60 * len(page)


def test_deep_tables_lose_no_text():
    words = [f"w{i}" for i in range(300)]
    text = extract("".join(f"<table><tr><td>{w}<td>x{w}" for w in words))
    assert sorted(text.replace("|", " ").split()) == sorted(x for w in words for x in (w, f"x{w}"))


def test_random_tables_line_up():
    """Without spans: cells padded to their column, bars between, nothing behind the last cell's text."""
    r = random.Random(4)
    for _ in range(200):
        rows = [[" ".join("ab"[: r.randrange(1, 3)] * r.randrange(1, 4) for _ in range(r.randrange(0, 3))) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 6))]
        page = "<table>" + "".join(r.choice(["<tr>", "<tbody><tr>"]) + "".join(f"<td>{c}" + r.choice(["", "</td>"]) for c in row) + r.choice(["", "</tr>"]) for row in rows) + r.choice(["", "</table>"])
        width = [max(len(row[k]) for row in rows if k < len(row)) for k in range(max(map(len, rows)))]
        want = [" | ".join(c.ljust(width[k]) for k, c in enumerate(row)).rstrip() for row in rows if any(row)]
        assert [x.rstrip(" |") for x in extract(page).split("\n") if x.strip(" |")] == [x.rstrip(" |") for x in want], page


class Visible(html.parser.HTMLParser):
    """The words outside of a few unseen elements; enough for the given pages."""

    UNSEEN = {"head", "script", "style", "title", "template", "noscript", "iframe", "svg", "object"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.UNSEEN
        if tag in ("br", "p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "nav", "article", "footer", "ul", "table", "hr", "body"):
            self.found.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag in self.UNSEEN and self.depth > 0
        self.handle_starttag(tag, []) if tag not in self.UNSEEN else None

    def handle_data(self, data):
        if not self.depth:
            self.found.append(data)


def words(text):
    return [w for w in re.split(r"[\s|]+", text) if w.strip("-#>") and not re.fullmatch(r"\d+\.", w)]


def test_given_pages_have_all_visible_words(spark):
    pages = table(spark, SMALL, "pages")
    setup(spark)
    got = {r.page_id: r for r in page_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        reader = Visible()
        reader.feed(r.html)
        assert words(got[r.page_id].text) == words("".join(reader.found)), r.page_id
        assert got[r.page_id].text_sha256 == hashlib.sha256(got[r.page_id].text.encode()).hexdigest() and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_random_pages_keep_their_words():
    """Every visible word of well-formed random pages comes out, once and in order."""
    r = random.Random(3)
    n = 0

    def made(depth):
        nonlocal n
        n += 1
        if depth > 5 or r.random() < 0.3:
            return f" w{n} "
        tag = r.choice(["div", "p", "span", "ul", "table", "blockquote", "section", "b", "pre", "h2"])
        inner = [made(depth + 1 + (tag == "p") * 5) for _ in range(r.randrange(1, 4))]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>"
        if tag == "table":
            return "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in inner) + "</table>"
        if tag in ("span", "b", "p", "h2", "pre"):
            inner = [f" w{n}.{i} " for i in range(len(inner))]
        return f"<{tag}>{''.join(inner)}</{tag}>"

    for _ in range(300):
        page = made(0)
        assert words(extract(page)) == words(re.sub(r"<[^>]*>", " ", page))


def test_rows_of_any_kind(spark):
    setup(spark)
    rows = [(1, "<p>a"), (1, "<p>b"), (None, "<p>c"), (2, None), (3, ""), (4, "x" * 300_000)]
    df = spark.createDataFrame([(i, h, 1, "k") for i, h in rows], "page_id long, html string, n_chars int, text string")
    got = sorted(((r.page_id, r.text) for r in page_texts(df).collect()), key=repr)
    assert got == sorted(((1, "a"), (1, "b"), (None, "c"), (2, ""), (3, ""), (4, "x" * 300_000)), key=repr)
    assert page_texts(df).columns == ["page_id", "text", "n_chars", "text_sha256"] and page_texts(df.limit(0)).count() == 0
