"""Reading of pages: attribute rules, unclosed markup, linear time, and hand-made pages."""

import time

import pytest

from spellframe.llm import main_text as mt

texts = lambda page: [b.text for b in mt.blocks(page)]


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p title=it's>Story isn't told</p><p>Second part</p></article>", ["Story isn't told", "Second part"]),
    ('<p data-x="a > b" title=\'<p>no\'>Yes</p>', ["Yes"]),
    ('<p title="never closed>Text</p><p>more</p>', ["Text", "more"]),
    ("<p a=b/c=d>Slash</p><a href=/x/>link</a>", ["Slash", "link"]),
    ("<p =x ==y a = 'b' c= \"d\" e>Odd names</p>", ["Odd names"]),
    ("one <b", ["one"]), ("a < b and 3<4 </ no> c", ["a < b and 3<4 c"]),
    ("<!-->shown<!--->too<!-- not --!>end<!-- never", ["showntooend"]), ("<!DOCTYPE html><?xml no?>x", ["x"]),
    ("<script type='a'>if (a</b) '</p>' </scripty></SCRIPT >after", ["after"]), ("<script>never closed <p>no", []), ("<scripts>yes", ["yes"]),
    ("<div></b></div></p></x>plain<b></div>still", ["plain", "still"]),
    ("<b><b><p>one<p>two</b>three", ["one", "twothree"]),
    ("<ul><li>1<li>2<ul><li>3</ul>4</ul>5", ["1", "2", "3", "4", "5"]),
])
def test_markup(page, want):
    assert texts(page) == want


def test_path_and_links():
    a, b = mt.blocks('<div class="Top nav" id=x><a href=/a>Home</a></div><div role=main>Text</div>')
    marks = lambda *names: sum(1 << mt.crc32(n.encode()) % mt.PATHS for n in names)
    assert (a.path, a.linked, a.text) == (marks("div", ".top", ".nav", ".x"), 4, "Home")
    assert (b.path, b.linked) == (marks("div", ".main"), 0)


@pytest.mark.parametrize("page", ["<a " * 10**6, "<a title=\"" * 10**5, "<p x='" * 10**5 + "<p y=\"" * 10**5, "<div>x" * 10**5, "<div>" * 10**5 + "</x>" * 10**5, "<b>" * 10**5 + "<div></div>" * 10**5,
                                  "<!--" * 10**6, "<script>" * 10**5, "</" * 10**6, "<" * 10**6, "<p a  " * 10**5, "<body>" * 10**5, "<title " * 10**5, "&" * 10**6, "<p " + " " * 10**6])
def test_time_grows_with_the_page_only(page):
    start = time.perf_counter()
    mt.blocks(page)
    assert time.perf_counter() - start < 5


PAGES = [
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Bridge</title><link rel=stylesheet href=/s.css></head><body>
<header class="site-header"><a href=/>The Daily</a></header><nav id=menu><ul><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav>
<main><article><h1>New bridge opens</h1><p class=lead>The town's new bridge was opened on Monday after four years of work on both sides of the river.
<p>It carries two lanes &amp; a path for cyclists, and it is expected to take most of the traffic from the old one &mdash; which stays.</article></main>
<aside class=related><h3>Related</h3><a href=/1>Old bridge closes</a></aside><section id=comments><div class=comment><p>Great news!</p></div></section>
<footer><p>&copy; The Daily</p></footer></body></html>""",
     "New bridge opens The town's new bridge was opened on Monday after four years of work on both sides of the river. "
     "It carries two lanes & a path for cyclists, and it is expected to take most of the traffic from the old one — which stays."),
    ("""<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><div class="nav"><a href="/">Home</a> | <a href="/blog">Blog</a></div>
<div class="post entry"><h2>Bread without kneading</h2><div>Mix flour, water and salt in the evening, cover the bowl and leave it until the next morning.</div>
<ul><li>500 g of flour, as fresh as you can get</li><li>350 g of water, not too warm</li></ul><div>Bake it for forty minutes in a hot oven, with a bowl of water below.</div></div>
<div class="sidebar"><a href="/x">About me</a></div><div class="footer">All recipes are my own</div>""",
     "Bread without kneading Mix flour, water and salt in the evening, cover the bowl and leave it until the next morning. 500 g of flour, as fresh as you can get "
     "350 g of water, not too warm Bake it for forty minutes in a hot oven, with a bowl of water below."),
]


@pytest.fixture(scope="module")
def model():
    return mt.trained()


def test_hand_made_pages(spark, model):
    rows = [(i, f"u{i}", page, "x", 1) for i, (page, _) in enumerate(PAGES)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert {r.page_id: r.text for r in mt.main_text(frame, model=model).collect()} == {i: want for i, (_, want) in enumerate(PAGES)}
    assert mt.main_text(frame.limit(0), model=model).count() == 0


def test_long_page_and_long_block(spark, model):
    """Ten megabytes in one article: all of it is text, and words behind the fortieth count."""
    said = " ".join(f"word{k % 977} and more of the story" for k in range(20_000))
    page = "<nav><a href=/>Home</a></nav><article><h1>Long story</h1>" + f"<p>{said}</p>" * 18 + "</article><footer>us</footer>"
    got = mt.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), model=model).first()
    assert len(page) > 10_000_000 and got.text == " ".join(["Long story", *[said] * 18]) and got.n_chars == len(got.text)
    first, second = mt.features([mt.Block(0, " ".join(["same"] * 50 + [x] * 50), 0) for x in ("this", "that")])
    assert (first != second).any()
