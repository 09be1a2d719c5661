"""Extraction against plain rules: the articles of the given pages, the rules of both passes, and time in proportion to length."""

import os
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from quarry.llm import html

SF = "/root/testdata/sf0.01"
TEXT = "This is the story of the man who was in the house and of the things that he had with him on that day. "
FOREIGN = "Tämä on pitkä kappale suomeksi eikä siinä ole yhtään tuttua täytesanaa vaan pelkkiä muita sanoja peräkkäin. "


class PlainArticle(HTMLParser):
    """All text inside article elements, cut at block tags, without asides, forms, scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.off, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.off += tag in ("aside", "form", "script", "style", "nav")
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in html.BLOCK_TAGS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in html.BLOCK_TAGS:
            self.blocks.append("")
        self.inside -= tag == "article"
        self.off -= tag in ("aside", "form", "script", "style", "nav")

    def handle_data(self, data):
        if self.inside > 0 and self.off <= 0:
            self.blocks[-1] += data


def plain(page):
    p = PlainArticle()
    p.feed(page)
    p.close()
    return "\n".join(filter(None, (" ".join(b.split()) for b in p.blocks)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {r.page_id: plain(r.html) for r in pages.collect()}
    rules = Counter()
    for r in pages.collect():
        blocks = html.split_blocks(r.html)
        html.label_blocks(blocks)
        rules.update((b.label, b.rule) for b in blocks)
    assert {("good", "long, stop words"), ("good", "near: neighbours"), ("good", "short: neighbours"), ("bad", "many links"), ("bad", "veto")} <= set(rules)


def rules(page):
    blocks = html.split_blocks(page)
    html.label_blocks(blocks)
    return [(b.label, b.rule) for b in blocks]


def test_first_pass():
    assert rules(f"<p>{TEXT * 3}</p>") == [("good", "long, stop words")]
    assert rules(f"<p>{TEXT * 3}</p><p><a href=x>One</a> <a href=y>two</a></p>")[1] == ("bad", "many links")
    assert rules(f"<p>{TEXT * 3}</p><p>{FOREIGN * 2}</p>")[1] == ("bad", "few stop words")
    assert rules(f"<p>{TEXT * 3}</p><p>All of it at <a href=x>site</a> and so on and on</p>")[1] == ("bad", "short with links")
    assert rules(f"<p>{TEXT * 3}</p><div class='cookie-notice'><p>{TEXT * 3}</p></div>")[1] == ("bad", "veto")


def test_second_pass():
    assert rules(f"<p>Lead.</p><p>{TEXT * 3}</p><p>End.</p>") == [("good", "short: neighbours"), ("good", "long, stop words"), ("good", "short: neighbours")]
    links = "<p><a href=x>One</a> <a href=y>two</a></p>"
    assert rules(f"<p>{TEXT * 3}</p><p>a</p><p>b</p><p>c</p>{links}") == [("good", "long, stop words"), ("good", "short: nearer side"), ("bad", "short: nearer side"), ("bad", "short: nearer side"), ("bad", "many links")]
    assert rules(f"{links}<p>x</p><h2>Heading</h2><p>{TEXT * 3}</p>")[1:3] == [("bad", "short: nearer side"), ("good", "short: content on one side")]
    assert rules(f"{links}<p>{TEXT}</p><p>{TEXT * 3}</p>")[1] == ("good", "near: content on one side")
    assert rules("<p>Only this.</p>") == [("bad", "short: neighbours")]


def test_articles_are_whole_in_any_language():
    assert html.main_text(f"<div>Out</div><article><p>Ei</p><p>{FOREIGN * 4}</p><p>See <a href=x>the list of all</a></p><aside>No</aside><p>Loppu</p></article><p>Out</p>").split("\n") == ["Ei", (FOREIGN * 4).strip(), "See the list of all", "Loppu"]
    assert html.main_text(f"<p>{FOREIGN * 4}</p><p>Loppu</p>").split("\n") == [(FOREIGN * 4).strip(), "Loppu"]


def test_unclosed_elements():
    assert html.main_text("<article><p>Text <script>var a = 1; <p>more") == "Text"
    assert html.main_text("<article><p>One<p>Two <b>three<p>Four</article><p>x") == "One\nTwo three\nFour"


@pytest.mark.parametrize("page", ["<div>", "<b><p>", "</x></div>", "<p><b>", "<li>x", "<a href='", "<b><div></b>"])
def test_time_in_proportion_to_length(page):
    began = time.time()
    html.main_text(page * 100_000)
    assert time.time() - began < 10  # some tenths of a second; a scan of the open elements for each tag takes minutes


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{TEXT}</p></article>", "x", 7, 1.0)], "page_id long, url string, html string, text string, n_chars int, _html double")
    assert html.extract(df).collect()[0].asDict() == {"page_id": 1, "url": "u", "text": TEXT.strip(), "n_chars": len(TEXT.strip())}
