"""Links in broken markup, against the standard library's event parser."""

import random
from html.parser import HTMLParser

from contactgrid.functions import html
from contactgrid.operators import links

PIECES = [
    "<a href='/one'>", '<a title="a>b" href="/two">', "<a href=/three>", '<a href="/f" HREF="/g">',
    "<A\nclass=x\thref = '/h?a=1&amp;b=2'>", "<a name=q>", '<a href="">', "<a href>", "<a>",
    "<a data-href='/no'>", "<a title=' href=/no'>", "<a/href=/slash>", '<a title="x"href="/tight">',
    "</a>", "</a >", "</A\n>", "</abbr>", "<abbr title='<a href=/no>'>", "<b>", "</b>", "<br/>",
    '<img alt="a > b">', '<img alt="<script>">', "<p class='</a>'>", "text", " more  text ", "&amp;",
    "1 < 2", "x > y", "<!-- <a href='/comment'> -->", "<script>'<a href=/js></a>'</script>",
    "<style>a>b{}</style>", "<template>", "</template>", "<!doctype html>", "<?php x ?>",
    "<a href='mailto:me@x.example?subject=a>b'>", '<a title="1>0" href="MailTo:you@y.example">',
    "<a href='&#109;ailto:coded@z.example'>", "<base href='/dir/'>", '<base target="a>b" href=/d2/>',
]


class Walk(HTMLParser):
    """Anchors that close, all addresses and the first base, outside ignored elements."""

    def __init__(self, ignored):
        super().__init__()
        self.ignored, self.inside = ignored, []
        self.closed, self.all, self.base = [], [], None
        self.now, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in self.ignored:
            self.inside.append(tag)
        elif not self.inside:
            href = {name: value for name, value in attrs if value is not None}.get("href")
            if tag == "base" and href and self.base is None:
                self.base = href
            if tag == "a" and href:
                self.now, self.text = href, []
                self.all.append(href)

    def handle_endtag(self, tag):
        if self.inside:
            if self.inside[-1] == tag:
                self.inside.pop()
        elif tag == "a" and self.now is not None:
            self.closed.append((self.now, " ".join("".join(self.text).split())))
            self.now = None

    def handle_data(self, data):
        if not self.inside and self.now is not None:
            self.text.append(data)


def walk(page, *ignored):
    parser = Walk(ignored)
    parser.feed(page)
    parser.close()
    return parser


def pages_of(spark, texts):
    return spark.createDataFrame(
        [(n, "https://e.com/", text) for n, text in enumerate(texts)],
        "page_id long, url string, html string")


def broken(seed, many, skip=()):
    rng = random.Random(seed)
    usable = [piece for piece in PIECES if piece not in skip]
    return ["".join(rng.choices(usable, k=rng.randint(1, 14))) for _ in range(many)]


def test_anchors_of_broken_markup(spark):
    texts = broken(1, 1500, ("<template>", "</template>"))
    found = links.raw_anchors(pages_of(spark, texts)).select("page_id", "found").collect()
    got = {r.page_id: [(a.href, a.link_text) for a in r.found] for r in found}
    assert got == {n: walk(text, "script", "style").closed for n, text in enumerate(texts)}


def test_addresses_and_base_of_broken_markup(spark):
    texts = broken(2, 1500, ("<template>", "</template>"))
    pages = pages_of(spark, texts)
    marked = html.mark_tags(pages.html, html.LINK_MARKUP)
    rows = pages.select("page_id", html.link_addresses(marked).alias("links"),
                        html.base_address(marked).alias("base")).collect()
    for row in rows:
        known = walk(texts[row.page_id], "script", "style")
        decoded = [link.replace("&amp;", "&").replace("&#109;", "m") for link in row.links]
        assert (decoded, row.base) == (known.all, known.base)


def test_hostile_pages_take_linear_time(spark):
    size = 300_000
    texts = ["<a " * size, "<a href='" * size, '<a title="' + "x" * size, "<a " + "b=" * size,
             "<a href=x>" * size, "<" * size, "<a " + "'\" " * size + ">", "<!--" * size,
             "<script>" + "<a href=x>" * size, "<a " + "href=x " * size + ">y</a>"]
    rows = links.raw_anchors(pages_of(spark, texts)).select("page_id", "found").collect()
    found = {r.page_id: [(a.href, a.link_text) for a in r.found] for r in rows}
    assert found[9] == [("x", "y")] and not any(found[n] for n in range(9) if n != 6)
