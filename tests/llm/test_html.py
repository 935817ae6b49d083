"""Main text: parsing, what a name and what a count decides, against pages whose text is known as they are made."""

import random
from html.parser import HTMLParser

import pytest

from ledgerloom.llm import html
from ledgerloom.llm.html import Template, blocks, digest, main_text, parse
from ledgerloom.llm.queries import op6_site_template_removal
from tests.conftest import SMALL


def text(page, template=None):
    root = parse(page)
    digest(root)
    return blocks(root, template or Template())


def test_blocks():
    page = '<html><body><header><h1>Site</h1></header><div id="cookie-banner">We use</div><main><article><header><h2>T &eacute;</h2></header><p>A<b>b</b> c<p>d<br>e<ul><li>x<li>y</ul><div class="comments"><p>nice</div><form><p>q</form>' "<table><tr><td>1<td>2<tr><td>3</table><pre>a\n b</pre>tail</article></main><aside>z</aside><footer>f</footer><script>if(a<b)</script><p"
    assert text(page) == ["T é", "Ab c", "d e", "x", "y", "1", "2", "3", "a b", "tail"]
    assert text("plain &lt;text&gt; &amp; more") == ["plain <text> & more"]
    assert text("") == [] and text("<p>a<!-- b --><p class='ad'>c<p>d") == ["a", "d"]


def test_names_in_an_article():
    """Only whole names drop a part of an article; headings, tables, section ids and negated names don't."""
    kept = '<section id="side-effects"><p>a</p></section><h2 id="related-work">b</h2><h2 id="market-share">c</h2><div class="entry-header"><h1>d</h1></div><div class="post-content no-sidebar">e</div><p class="alert">f</p><table class="menu"><tr><td>g</table>'
    gone = '<div class="ad">1</div><div class="box Related">2</div><div id="comments">3</div><div class="share-buttons">4</div><section class="related-posts">5</section><div class="ad-slot">6</div>'
    assert text(f"<article>{kept}{gone}</article>") == list("abcdefg")
    assert text(f'<div class="page without-sidebar"><article class="commentary">{kept}</article></div><article class="odd comment"><p>7</p></article>') == list("abcdefg")
    assert text('<div class="site-header">1</div><p>a</p>') == ["a"]


BODY = "".join(f"<p>Sentence {i} of the text.</p>" for i in range(5))
WANT = [f"Sentence {i} of the text." for i in range(5)]


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content-header"><h1>Title</h1></div><div id="market-share">{BODY}</div></body>', f'<div class="post-comments-off"><h1>Title</h1>{BODY}</div>', f'<div class="social-policy"><h1>Title</h1>{BODY}</div>',
        f'<div class="search-results"><h1>Title</h1>{BODY}</div>', f'<form id="aspnetForm"><h1>Title</h1>{BODY}</form>', f'<div class="sidebar"><h1>Title</h1>{BODY}</div>', f'<div class="widget"><div role="form"><h1>Title</h1>{BODY}</div></div>',
        f'<body class="search"><main class="menu"><h1>Title</h1>{BODY}</main></body>', f'<header><h1>Title</h1>{BODY}</header><footer>f</footer>',
    ],
)
def test_no_name_takes_most_of_a_page(page):
    assert text(page) == ["Title", *WANT]


def test_text_within_a_line_stays():
    page = '<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding="x">E=m</annotation></math> here.</p><p>Press <button>OK</button> or <label>Enter</label> now.</p><div><button>Menu</button></div><label>Name</label></article>'
    assert text(page) == ["Energy is E=m here.", "Press OK or Enter now."]


def rows_of(spark, rows):
    pages = [(i, f"https://{h.upper()}:80/{s}/{i}", page, "clash", 1) for i, (h, s, page) in enumerate(rows)] + [(901, None, None, "clash", 1), (902, "x", "", "clash", 1)]
    return spark.createDataFrame(pages, "page_id long, url string, html string, host string, `sec``tion` int")


def test_site_template(spark):
    """Templates of large and small hosts, of a section, in articles, of copied pages; nulls, repeats, clashing names, no rows."""
    menu = "<div class=x>Same <i>on</i> all</div>"
    rows, want = [], []

    def page(host, section, source, *expected):
        rows.append((host, section, source))
        want.append(list(expected))

    for i in range(30):
        page("h.example", "a", f"<body>{menu}<div>Own text {i}</div><section><p>Said on {'all' if i % 2 else i}</p></section></body>", f"Own text {i}", *([] if i % 2 else [f"Said on {i}"]))
    for i in range(300, 304):
        page("h.example", "b", f"<body><div>Own {i}</div><div>Section b</div></body>", f"Own {i}")
    for i in range(3):
        page("small.example", "", f"<body>{menu}<div>Small {i}</div></body>", f"Small {i}")
    for i in range(2):
        page("two.example", "", f"<body>{menu}<div>Two {i}</div></body>", "Same on all", f"Two {i}")
    for i in range(20):
        said = "Quoted by some here" if i < 9 else "Only here"  # on 9 of 20 pages, and on 11
        page("blog.example", "", f"<article><h1>Title {i}</h1><p>Follow us for more</p><p>{said}</p><p>Own {i}</p></article>", f"Title {i}", *([said] if i < 9 else []), f"Own {i}")
    for i in range(9):
        page("copy.example", "", "<article><p>The same page</p></article>", "The same page")
    for i in range(3):
        page("copy.example", "", f"<article><p>Other {i}</p></article>", f"Other {i}")
    given = rows_of(spark, rows)
    got = {r.page_id: r for r in main_text(given).collect()}
    assert len(got) == len(rows) + 2 and all(r.host == "clash" and r["sec`tion"] == 1 for r in got.values())
    for i, expected in enumerate(want):
        assert got[i].blocks == expected, rows[i]
    assert got[901].blocks == [] and got[902].blocks == []
    assert main_text(given.where("false")).count() == 0


def test_places_are_counted_where_the_content_is_drawn_anew(spark):
    """Adverts, notices and comments of drawn words, beside an article, in it, and on pages without one; wrappers with such names stay."""
    draw = random.Random(1)
    some = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    rows, want = [], []
    for i in range(12):
        text_ = [some(30), some(20)]
        body = "".join(f"<p>{t}</p>" for t in text_)
        rows.append(("art.example", "", f'<body><div class="x{i}">{some(5)}</div><article><h1>T {i}</h1>{body}<div class="ad">{some(6)}</div></article><div>{some(9)}</div><section class="c"><p>{some(40)}</p></section></body>'))
        want.append([f"T {i}", *text_])
        rows.append(("plain.example", "", f'<body><div class="promo-box">{some(4)}</div><div class="sidebar post-{i}"><h1>T {i}</h1>{body}</div><div id="comments">{some(8)}</div></body>'))
        want.append([f"T {i}", *text_])
    rows.append(("art.example", "", "<body><article><p>Alone</p></article><blockquote>Only on this page, in a place that no other has</blockquote></body>"))
    want.append(["Alone", "Only on this page, in a place that no other has"])
    got = {r.page_id: r.blocks for r in main_text(rows_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want


class Article(HTMLParser):
    """The blocks of the article elements of the given pages, by Python's parser: paragraphs and headings, tags within dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.now = 0, [], []

    def flush(self):
        if words := " ".join("".join(self.now).split()):
            self.out.append(words)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("article", "p", "h1", "h2", "h3", "li", "ul", "div", "table", "tr", "td"):
            self.flush()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "h3", "li", "ul", "div", "table", "tr", "td"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


def test_the_given_pages_against_another_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in op6_site_template_removal(spark, SMALL).collect()}
    assert len(got) == len(pages)
    for i, page in pages.items():
        reader = Article()
        reader.feed(page.html)
        reader.close()
        reader.flush()
        assert got[i].text == "\n\n".join(reader.out) and got[i].n_chars == len(got[i].text) and got[i].url == page.url


def test_the_count_decides_on_the_given_pages(spark, monkeypatch):
    """With all templates emptied, most pages of hosts that can be counted keep what stands beside the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    counted = {r.page_id: r.blocks for r in main_text(pages).collect()}
    real = html._template
    monkeypatch.setattr(html, "_template", lambda counts, *given: real(counts.where("digest is null"), *given))
    empty = {r.page_id: r.blocks for r in main_text(pages).collect()}
    assert sum(counted[i] != empty[i] for i in counted) > len(counted) / 2
