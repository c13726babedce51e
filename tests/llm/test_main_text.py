"""Main text: malformed markup, elements that no list may drop, given pages against another parser, and rows of all kinds."""

import os
from html.parser import HTMLParser

import pytest

from obsflow.llm import extract
from obsflow.llm.dom import parse

GIVEN = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def model():
    return extract.train()


def plain(source):
    return " ".join("".join(t for _, t, _ in parse(source).texts).split())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<p>One</p><a href="x" title="5" tall">two</a><p>three</p>', "Onetwothree"),
        ('<p title="a" b">Hello</p><p>World</p>', "HelloWorld"),
        ("<p title='a>b' c=d/e>x</p>", "x"),
        ('<p class=a"b>x</p>y', "xy"),
        ('<p title="never closed>Hello</p><p>World</p>', "HelloWorld"),
        ("<p =x y= z>one</p>", "one"),
        ("a < b and c<d>e</d> <", "a < b and ce <"),
        ("a<!--x>y-->b<!-->c<!--->d<!-- e --!>f</ x>g<?p q?>h", "abcdfgh"),
        ("Sum <math>x</math> end", "Sum x end"),
        ("<p>a <object>b</object> <canvas>c</canvas> <noscript>d</noscript> <map>e</map></p>", "a b c d e"),
        ("<p>a<select><option>b</select><button>c</button><textarea><p>d</textarea><script>'</p>'</script><style>p{}</style>e", "ae"),
        ("<p>a</p><scr", "a"),
        ("&lt;b&gt; &amp; &copy x", "<b> & © x"),
    ],
)
def test_reader_keeps_text(source, want):
    assert plain(source) == want


def test_long_broken_tags_take_linear_time():
    assert plain("<p " + "a" * 200_000 + '="x" ' * 1000 + "y") == ""
    assert plain('<p a="' * 2000 + "x") is not None


class ArticleText(HTMLParser):
    """The text in <article>, by the standard library's parser; block elements begin a line."""

    BLOCKS = {"p", "h1", "h2", "li", "ul", "div", "article", "blockquote", "table", "tr", "td"}

    def __init__(self, page):
        super().__init__()
        self.lines, self.inside = [""], False
        self.feed(page)
        self.text = "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)

    def _tag(self, tag, inside):
        if tag == "article":
            self.inside = inside
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_starttag(self, tag, attrs):
        self._tag(tag, True)

    def handle_endtag(self, tag):
        self._tag(tag, False)

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="needs the given pages")
def test_given_pages_equal_another_parser(model):
    import pyarrow.parquet as pq

    pages = pq.read_table(GIVEN).column("html").to_pylist()
    assert len(pages) > 100
    got = extract.main_texts(pages, model)
    assert sum(g != ArticleText(p).text for g, p in zip(got, pages, strict=True)) == 0


def test_rows_of_all_kinds(spark, model):
    page = "<html><body><nav><a href=/>Home</a> <a href=/b>More</a></nav><article><h1>A title</h1><p>" + "Some words of text, to be read. " * 9 + "</p></article></body>"
    long = page.replace("</p>", "</p>" + "<p>Another paragraph with words enough to read.</p>" * 20_000)
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, None, long, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(extract.extracted(table, model).collect(), key=lambda r: (r.page_id is None, r.page_id))
    want = "A title\n" + " ".join(["Some words of text, to be read."] * 9)
    assert [(r.page_id, r.text) for r in got[:4]] == [(1, want), (1, want), (2, ""), (3, "")]
    assert got[4].text == want + "\nAnother paragraph with words enough to read." * 20_000 and got[4].n_chars == len(got[4].text)
    assert extract.extracted(table.where("false"), model).count() == 0
