"""Main text of pages: declared parts, site templates, broken markup, copies."""

from __future__ import annotations

import pytest

from tallyloom.llm import html

ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{x:1}</style></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav>
<div id="cookie-notice">We use cookies</div>
<article><header><h1>Head&amp;line</h1><p>By someone</p></header>
<p>First  <b>bold</b>\n text &lt;b&gt; &#233;&nbsp;x<script>var a = "<p>no</p>";</script></p>
<p>Second<br>line<div class="advert"><p>Buy</p></div>
<ul><li>One<li>Two</ul><table><tr><td>a<td>b</table>
<aside>Side</aside><form><label>Name</label></form>
<section class="comments"><article><p>A reader</p></article></section>
<!-- <p>hidden</p> --></article>
<div class="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def text(page: str) -> str:
    roots, marked = html.article_root(html.subtree_hashes(html.parse(page)))
    return "\n".join(html.blocks(roots, marked))


def test_declared_parts_go():
    assert text(ARTICLE) == "Head&line\nFirst bold text <b> é x\nSecond line\nOne\nTwo\na\nb"


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("just text & more", "just text & more"),
        ("<p>a<p>b", "a\nb"),
        ("<article><p><b>T<br><p>x</p></article>", "T\nx"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<main><div>a<span>b</span>c</div></main>", "abc"),
        ("<body><nav>n</nav><div role='banner'>r</div><div>x</div></body>", "x"),
        ("<article><p class='notice-text'>kept</p></article>", "kept"),
        ("<article><p class='advert'>buy</p><p>x</p></article>", "x"),
        ("<body class='no-menu'><div class='with-sidebar'><p>x</p><div id='sidebar-2'>y</div></div></body>", "x"),
        ("<article><div class='entry-header'><h1>T</h1></div><div class='post-comments'>c</div></article>", "T"),
        ("<script>unclosed <p>a</p>", ""),
    ],
)
def test_odd_markup(page, expected):
    assert text(page) == expected


def test_deep_and_long_pages():
    assert text("<div>" * 5_000 + "x" + "</div>" * 5_000) == "x"
    assert len(text("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 10 - 1


SCHEMA = "page_id long, url string, html string, host string"


def site(n: int, body: str, start: int = 0, where: str = "a.example.com") -> list[tuple]:
    return [(start + i, f"https://{where}/{i}", body.replace("#", str(start + i)), "x") for i in range(n)]


def extract(spark, rows, **options) -> dict:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["page_id"]: r["text"] for r in html.extract_pages(df, **options).collect()}


def test_recurring_subtrees_go_and_copies_stay(spark, monkeypatch):
    template = "<body><div><b>Follow us</b></div><div><p>text # one</p><p>All rights reserved.</p></div></body>"
    copy = "<body><div><b>Follow me</b></div><div><p>the same</p></div></body>"
    rows = site(12, template) + site(30, copy, 100) + site(3, template, 200, "b.example.com")
    for most in (html.BROADCAST_HASHES, 0):
        monkeypatch.setattr(html, "BROADCAST_HASHES", most)
        got = extract(spark, rows)
        assert got[3] == "text 3 one\nAll rights reserved."
        assert got[110] == "Follow me\nthe same"
        assert got[201] == "Follow us\ntext 201 one\nAll rights reserved."


def test_nulls_repeats_and_no_pages(spark):
    rows = [(1, None, None, ""), (None, "x", "<p>a</p>", ""), (2, "", "", ""), (2, "", "", "")]
    df = html.extract_pages(spark.createDataFrame(rows, SCHEMA))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in df.collect()), key=repr)
    assert got == [(1, "", 0), (2, "", 0), (2, "", 0), (None, "a", 1)]
    assert extract(spark, []) == {}


def test_article_text_of_a_hot_host_stays(spark):
    link = "<p>page # has <a href='/x'>common</a> words</p><div>and <em>loose</em> text #</div>"
    table = "<table><tr><td>Total</td><td>0</td></tr><tr><td>n#</td></tr></table>"
    quoted = "<section><div>a passage that few pages of a large site quote</div></section>"
    rows = site(20, f"<body><article>{link}{table}<div><b>Follow us</b></div></article></body>")
    rows += site(180, "<body><article><p>page # of others</p><div><b>Follow us</b></div></article></body>", 100)
    rows += site(12, f"<body><article><p>quoting #</p>{quoted}</article></body>", 400)
    # Near copies differ in their headlines, and are most of the pages of their own host too.
    parts = "".join(f"<section><div>part {i} of the story that was copied</div></section>" for i in range(5))
    near = f"<body><h1>Headline #</h1>{parts}</body>"
    rows += site(10, near, 500) + site(10, near, 600, "c.example.com")
    got = extract(spark, rows)
    assert got[3] == "page 3 has common words\nand loose text 3\nTotal\n0\nn3"
    assert got[150] == "page 150 of others"
    assert got[405] == "quoting 405\na passage that few pages of a large site quote"
    for i in (505, 605):
        assert got[i].split("\n") == [f"Headline {i}", *(f"part {k} of the story that was copied" for k in range(5))]


def test_most_of_an_article_is_no_template(spark, monkeypatch):
    body = "<div>" + "".join(f"<section>{w} text of a long story</section>" for w in "abcd") + "</div>"
    rows = site(10, f"<body><article><h1>#</h1><p>{'word ' * 9}#</p>{body}</article></body>")
    for most in (html.BROADCAST_HASHES, 0):
        monkeypatch.setattr(html, "BROADCAST_HASHES", most)
        assert all("c text of a long story" in t for t in extract(spark, rows).values())


def test_templates_of_small_hosts_go_and_formulas_stay(spark):
    formula = "<math><mi>x</mi><mo>=</mo><mn>#</mn><annotation>x</annotation></math>"
    page = f"<body><div><b>Follow us</b></div><div><p>text # with {formula} in it</p></div></body>"
    got = extract(spark, site(5, page))
    assert got[2] == "text 2 with x=2 in it"


def test_words_of_the_article_in_names_and_ids_delete_nothing():
    page = (
        '<article><p>First.</p><h2 id="related">Related work</h2><p id="share">a</p><h2 id="comments">Comments</h2>'
        '<div class="market-share-table"><p>b</p></div><section id="notice-of-intent"><p>c</p></section>'
        '<div class="ad-hoc"><p>d</p></div>'
        '<div class="ad-slot-2"><p>BAD</p></div><div id="comments"><p>BAD</p></div><p class="promo">BAD</p>'
        '<div class="newsletter-signup"><p>BAD</p></div><div class="related-posts"><p>BAD</p></div></article>'
    )
    roots, marked = html.article_root(html.subtree_hashes(html.parse(page)))
    assert html.blocks(roots, marked) == ["First.", "Related work", "a", "Comments", "b", "c", "d"]
