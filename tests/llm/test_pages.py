import random

import pytest

from coclave.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><div>Site name</div></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>Head &amp; tail</h1><p>First
  <b>bold</b>face&nbsp;&lt;tag&gt; text.<br>Line.<p>Second &#233;t&eacute; paragraph, long enough to be one.</p><div class="ad">Buy now!</div><p>Third.</p></article>
<section id="comments"><div class="comment"><p>I liked it.</p></div></section><aside>Related</aside><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""
WANT = "Head & tail First boldface <tag> text. Line. Second été paragraph, long enough to be one. Third."


def test_a_page():
    assert pages.train().extract(PAGE) == WANT


#: Layouts that the generator does not write, and the blocks of their article.
STORM = "<h1>Storm hits the coast</h1><p>A heavy storm reached the northern coast on Monday evening and damaged several houses.</p><p>Nobody was hurt, officials said on Tuesday.</p>"
STORM_TEXT = "Storm hits the coast A heavy storm reached the northern coast on Monday evening and damaged several houses. Nobody was hurt, officials said on Tuesday."
NAV, FOOT = "<nav><a href='/'>Home</a></nav>", "<footer>&copy; me</footer>"
LAYOUTS = {
    "bare boxes": (f"<title>t</title><body><div>Home News Sport</div><div>{STORM}</div><div>Copyright 2020 Example Ltd. All rights reserved.</div>", STORM_TEXT),
    "table": (f"<table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td>{STORM}</td></tr><tr><td colspan=2>Copyright 2020 Example Ltd</td></tr></table>", STORM_TEXT),
    "message in article": (f"{NAV}<article><h1>Title here</h1><div class='message'>It was sent by ship in the spring.</div><p>More text follows.</p></article>{FOOT}", "Title here It was sent by ship in the spring. More text follows."),
    "more in article": (f"{NAV}<article><h1>Title here</h1><p>First text.</p><p class='more'>The rest of the story is told here.</p></article>{FOOT}", "Title here First text. The rest of the story is told here."),
    "data attributes": (f"{NAV}<article><h1>Title here</h1><p data-id='nav menu' data-class='sidebar' title='a class=nav'>First text.</p><p>Second.</p></article>{FOOT}", "Title here First text. Second."),
    "graphics and formulae": (f"{NAV}<article><h1>Title <svg viewBox='0 0 1 1'/> here</h1><p>Area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.<svg><text>no</text></svg></p><p>Last line.</p></article>{FOOT}", "Title here Area x=2 holds. Last line."),
    "main": (
        "<header><h1>My Site</h1><p>A site about things</p></header><div id='cookie-banner'>We use cookies.<button>Accept</button></div><main><h1>Cooking rice</h1><p>Wash the rice twice.</p><div class='advertisement'>Buy the best pot now!</div>"
        "<p>Boil it for ten minutes.</p><ul><li>One cup of rice</li></ul><section class='comments'><h2>Comments</h2><p>Great recipe, thanks.</p></section></main><aside><h3>Related</h3><a href='/x'>Pasta</a></aside><footer>Contact us</footer>",
        "Cooking rice Wash the rice twice. Boil it for ten minutes. One cup of rice",
    ),
    "names around the whole page": (
        "<body class='post-template single'><div id='page' class='site'><div id='masthead' class='site-header'><a href='/'>Blog of Ann</a></div><div id='content' class='site-content'><div class='entry-content'><h1 class='entry-title'>On walking</h1><p>I walked for days.</p><p>It rained.</p>"
        "<div class='share'><a href='#'>Tweet</a></div></div><div id='comments' class='comments-area'><p>Nice post!</p></div></div><div id='secondary' class='widget-area'><p>Archives</p></div><div id='colophon' class='site-footer'>Proudly powered</div></div>",
        "On walking I walked for days. It rained.",
    ),
    "names that say nothing": (
        "<div>The Daily Paper</div><div><a href='/a'>Politics</a> | <a href='/b'>Culture</a> | <a href='/c'>Login</a></div><div class='c1'><div class='c2'><h1>Bridge closed</h1><div>The old bridge over the river was closed this morning, after engineers found cracks in two of its pillars.</div>"
        "<div>It will stay closed until the end of May.</div></div></div><div class='c3'>Subscribe to our newsletter <input></div><div class='c4'>&copy; 2024 The Daily Paper</div>",
        "Bridge closed The old bridge over the river was closed this morning, after engineers found cracks in two of its pillars. It will stay closed until the end of May.",
    ),
}


#: Small pages, written before the training pages had any like them.
FIRST = "The council agreed on Monday to repair the old town hall before the winter comes."
SECOND = "Work on the roof begins next week, and the clock will be cleaned in spring."
SMALL = {
    f"{tag}, {count}, {'wrapped' if wrapped else 'open'}": (
        "<html><body><div>Home News Sport</div>" + ("<div>" if wrapped else "") + "".join(f"<{tag}>{t}</{tag}>" for t in (FIRST, SECOND)[:count]) + ("</div>" if wrapped else "") + "<div>Copyright 2021 Example Ltd. All rights reserved.</div></body></html>",
        " ".join((FIRST, SECOND)[:count]),
    )
    for tag in ("p", "div")
    for count in (1, 2)
    for wrapped in (False, True)
} | {
    "title and a div": (f"<html><body><div>Home News Sport</div><h1>Town hall</h1><div>{FIRST}</div><div>Copyright 2021 Example Ltd</div></body></html>", f"Town hall {FIRST}"),
    "title and a p, wrapped": (f"<html><body><div>Home News Sport</div><div><h1>Town hall</h1><p>{FIRST}</p></div><div>Copyright 2021 Example Ltd</div></body></html>", f"Town hall {FIRST}"),
    "one paragraph": ("<p>Just one paragraph of plain text.</p>", "Just one paragraph of plain text."),
    "no markup": (f"{FIRST} {SECOND}", f"{FIRST} {SECOND}"),
    "two paragraphs and nothing else": (f"<html><body><p>{FIRST}</p><p>{SECOND}</p></body></html>", f"{FIRST} {SECOND}"),
    "an article element of one line": (f"<html><body><nav><a href='/'>Home</a></nav><article><p>{FIRST}</p></article><footer>Imprint</footer></body></html>", FIRST),
    "a table cell": (f"<table><tr><td><a href='/'>Home</a></td><td>{FIRST}</td></tr><tr><td colspan=2>Copyright 2021 Example Ltd</td></tr></table>", FIRST),
}


@pytest.mark.parametrize("name", SMALL)
def test_small_pages(name):
    page, wanted = SMALL[name]
    assert pages.train().extract(page) == wanted


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(name):
    page, wanted = LAYOUTS[name]
    assert pages.train().extract(f"<!DOCTYPE html><html>{page}</html>") == wanted


def test_unclosed_graphics_lose_nothing():
    assert [t for t, _, _ in pages.leaf_blocks("<p>a<svg><p>b</p>")] == ["a", "b"] and [t for t, _, _ in pages.leaf_blocks("<p>a<svg/></p><p>b</p><svg></svg>")] == ["a", "b"]
    assert [t for t, _, _ in pages.leaf_blocks("<p>a<script>b</p>")] == ["a"]


def test_held_out_accuracy():
    rng, field = random.Random(1234), pages.train()
    right = total = 0
    for _ in range(150):
        page, wanted = pages._labelled_page(rng)
        got = field.decode(pages.features(pages.leaf_blocks(page)))
        assert len(got) == len(wanted)
        right += sum(a == b for a, b in zip(got, wanted, strict=True))
        total += len(wanted)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling():
    rng, field = random.Random(2), pages.Field({"a": 1.5, "b": -0.7, "c": 0.2}, [[0.4, -0.9], [-0.3, 0.6]])
    for _ in range(50):
        rows = [tuple(rng.sample("abc", rng.randint(1, 3))) for _ in range(rng.randint(1, 8))]

        def score(labels, rows=rows):
            own = sum(sum(field.weights[f] for f in r) for r, y in zip(rows, labels, strict=True) if y)
            return own + sum(field.steps[x][y] for x, y in zip(labels, labels[1:], strict=False))

        best = max(score([k >> i & 1 for i in range(len(rows))]) for k in range(1 << len(rows)))
        assert abs(score([int(x) for x in field.decode(rows)]) - best) < 1e-9


def test_odd_rows(spark):
    cut = PAGE[: PAGE.index("paragraph,") + 5]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", cut), (4, "x", cut + "<di"), (5, "y", "plain text"), (6, "z", "<article>" + "<p>long words here</p>" * 20_000), (7, "q", '<p title="open>never closed')]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["url"]): r for r in pages.main_text(df).collect()}
    assert got[1, "u"]["text"] == WANT and got[2, None]["text"] == "" == got[None, "v"]["text"]
    assert got[3, "w"]["text"] == got[4, "x"]["text"] == WANT[: WANT.index("paragraph,") + 5]
    assert got[6, "z"]["n_chars"] == 20_000 * 16 - 1 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert pages.main_text(df.filter("false")).count() == 0
