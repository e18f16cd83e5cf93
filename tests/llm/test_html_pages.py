"""Pages read whole and in linear time; layouts without hints; all test pages against a plain parser."""

import time
from html.parser import HTMLParser

import pytest

from blockloom.llm import html


class Article(HTMLParser):
    """Text of a page's article, a line for each paragraph or heading: the test pages' articles hold nothing else."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.lines += [""] if tag in ("p", "h1", "article") else []
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.lines += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def plain(page):
    own = Article()
    own.feed(page or "")
    own.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in own.lines) if x)


def test_the_query_gives_the_article_of_every_page(spark, sf):
    want = {(r.page_id, r.url): plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html.op5_html(spark, sf).collect()
    assert len(got) == len(want) and all(r.text == want[r.page_id, r.url] and r.n_chars == len(r.text) for r in got)


def f1(chain, pages):
    hit = [(a, b) for page, labels in pages for a, b in zip(chain.decode(page), labels)]
    both, either = sum(a and b for a, b in hit), sum(a + b for a, b in hit)
    return 2 * both / either


def test_layouts_without_hints():
    chain = html.fit(html.training_pages(400))
    assert f1(chain, html.bare_pages(150, seed=99)) >= 0.95
    assert f1(chain, html.labelled_pages(150, seed=77)) >= 0.98


@pytest.mark.parametrize("bad", ["<" + "a" * 1_000_000, "<a 'x>' " * 120_000, "<b>" * 300_000 + "</i>" * 9000, "<a <a " * 150_000, "<div><br/>" * 100_000, "<p title=\"" * 100_000, "<!-" * 300_000, "<svg>" * 20_000])
def test_broken_pages_take_linear_time(bad):
    began = time.perf_counter()
    html.blocks(bad)
    assert time.perf_counter() - began < 15


def test_references_do_not_reach_over_tags():
    assert [b.text for b in html.blocks("<p>&am<b>p; &amp;amp; x&lt;<i>b&gt;</i></p>")] == ["&amp; &amp; x<b>"]


def test_content_stays():
    text = [b.text for b in html.blocks("<article><p>x<math><mi>y</mi></math> z</p><object><p>o</p></object><video>v</video></article>")]
    assert text[0] == "xy z" and "o" in text
