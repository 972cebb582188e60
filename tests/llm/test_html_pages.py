"""HTML extraction against the known text of whole pages, and the odd cases."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sievework.llm import dom, html_extract

AROUND = {"nav", "aside", "footer", "header", "form", "script", "style", "template"}


class Article(HTMLParser):
    """The blocks inside article elements, without those of menus, sidebars and forms."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.skipped = 0
        self.parts, self.blocks = [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in dom.BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.inside += tag == "article"
        self.skipped += tag in AROUND

    def handle_endtag(self, tag):
        if tag in dom.BLOCKS:
            self.flush()
        self.inside -= tag == "article"
        self.skipped -= tag in AROUND

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_pages_match_their_articles(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_extract.extract(pages, model).collect()
    wrong = 0
    for r in rows:
        want = Article()
        want.feed(r.html)
        want.flush()
        wrong += r.text != "\n\n".join(want.blocks)
        assert r.n_chars == len(r.text)
    assert len(rows) == 250 and wrong == 0


def test_odd_pages(spark, model):
    body = "".join(f"<p>This is sentence number {k} of the long story, and it goes on.</p>" for k in range(4000))
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>{body}</article><footer>&copy; x</footer></body></html>"
    rows = [(1, None), (2, ""), (3, page), (3, page), (4, "<<<>>><article"), (5, "\x00<p>\x00")]
    pages = spark.createDataFrame([(i, h, "u", "old", "x") for i, h in rows], "page_id long, html string, url string, Text string, n_chars string")
    got = html_extract.extract(pages, model)
    assert sorted(c.lower() for c in got.columns) == ["html", "n_chars", "page_id", "text", "url"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == by[2] == [""] and len(by[3]) == 2 and by[3][0] == by[3][1]
    assert by[3][0].startswith("Title\n\nThis is sentence number 0 of") and by[3][0].count("\n\n") == 4000
    assert html_extract.extract(pages.filter(F.lit(False)), model).count() == 0
