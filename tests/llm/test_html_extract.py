import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import html_extract


def test_viterbi_against_all_labellings():
    field, rng = html_extract.Field(), np.random.default_rng(0)
    for _ in range(50):
        field.moves, field.start = rng.normal(size=(2, 2)), rng.normal(size=2)
        scores = rng.normal(size=rng.integers(1, 8)).tolist()
        value = lambda y: field.start[y[0]] + sum(s for s, k in zip(scores, y) if k) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert tuple(field.viterbi(scores)) == best
    assert field.viterbi([]) == []


def test_held_out_accuracy():
    field, right, pages = html_extract.trained(), [], html_extract.labelled_blocks(html_extract.labelled_pages(300, seed=99))
    for blocks, labels in pages:
        right += [a == b for a, b in zip(field.viterbi(field.scores(blocks)), labels)]
    assert np.mean(right) > 0.99


def article_text(page):
    inner = re.search("<article>(.*)</article>", page, re.S).group(1).replace("<br>", " ")
    blocks = (re.sub("<[^>]*>", "", part) for part in re.split("</?(?:p|h1)>", inner))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        want = article_text(r.html)
        assert got[r.page_id] == (r.url, want, len(want))


PARTS = {
    "cookie": '<div class="cookie-notice"><p>Thon erti anre la.</p></div>',
    "aside": "<aside><h3>On er</h3><p>Ereti one. Anthe lor.</p></aside>",
    "comments": '<section id="comments"><h3>Er</h3><div class="comment"><p>Thonre la ti er. On ere ti!</p></div></section>',
    "form": "<form><label>Er ti</label><input name=a><button>On</button></form>",
    "script": "<script>if (a < b) document.write('<p>x</p>')</script><style>p{}</style>",
    "hidden": '<div style="display:none"><p>Er on ti.</p></div><template><p>On</p></template><!-- <p>er</p> -->',
}


@pytest.mark.parametrize("inside", [False, True])
def test_parts_that_go(inside):
    main = "<h1>Ereti &amp; on</h1><p>Th <b>on</b>er\n ti&nbsp;la.<p>One<br>two ré&#233;.</p><ul><li>Er one.</li></ul>"
    want = "Ereti & on\nTh oner ti la.\nOne two réé.\nEr one."
    noise = "".join(PARTS.values())
    page = f"<html><body><nav><a href=/>Er</a></nav><header>On er</header><article>{main}{noise if inside else ''}</article>{'' if inside else noise}<footer>&copy; on</footer></body></html>"
    assert html_extract.main_text(page, html_extract.trained()) == want


def test_broken_markup_and_edges(spark):
    rng = random.Random(1)
    bits = ["<", ">", "<p", "<p>", "</p>", "<!--", "-->", "<script>", "</scr", '"', "'", "<a href='", "&", "&amp;", "&#x;", "x", " ", "</div></div>", "<div class=", "<br/>", "<![CDATA["]
    pages = [None, "", "   ", "plain text only", "<article>" + "<p>er on ti.</p>" * 20000 + "</article>", "<div>" * 3000 + "x"] + ["".join(rng.choices(bits, k=30)) for _ in range(300)]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)] + [(1, None, "")], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = html_extract.extract(df).collect()
    assert len(got) == len(pages) + 1
    by = {r.page_id: r for r in got if r.url}
    assert by[0].text == by[1].text == by[2].text == "" and by[0].n_chars == 0
    assert by[4].n_chars == 20000 * 9 + 19999
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["a <b ", '<a "', "<a '\">", "<i>x<hr>", "<li><ul>", "<i></b>", "<a id=id=id=", "<!-- ", "<div class='a b'>x", "<script>", "<", "&am", "<p class=\"x'>y", "</"])
def test_hostile_pages_take_linear_time(unit):
    field, seconds = html_extract.trained(), []
    for size in (500_000, 1_000_000):
        began = time.process_time()
        html_extract.main_text("<p>one.</p>" + unit * (size // len(unit)), field)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 12 and seconds[1] < 3.5 * seconds[0] + 1, seconds


@pytest.mark.parametrize("page,want", [('<article><p>One more word.</p><div class="x', "One more word."), ("<article><p>One more word.</p></artic", "One more word."), ("<article><p>if a < b and c > d.</p>", "if a < b and c > d."), ('<article><p title="a>b">One more word.</p>', "One more word."), ("<article><p class=\"x>One more word.</p>", "One more word.")])
def test_no_markup_in_the_text(page, want):
    assert html_extract.main_text(page, html_extract.trained()) == want


SHAPES = {
    "old table page": ("<html><body bgcolor=white><table width=100%><tr><td colspan=2 class=top><a href=/>Home</a> | <a href=/a>About us</a> | <a href=/c>Contact</a></td></tr><tr><td class=sidebar><a href=1>News</a><br><a href=2>Archive</a></td><td class=content><h1>River report</h1><p>The river rose by two metres during the night, and the lower fields stood under water.</p><p>Nobody was hurt, but the mill will stay closed until the end of the month.</p></td></tr></table><div class=footer>&copy; 2004 The Valley Post</div></body></html>", ["River report", "The river rose by two metres during the night, and the lower fields stood under water.", "Nobody was hurt, but the mill will stay closed until the end of the month."]),
    "blog in divs": ("<body><div id='page'><div id='masthead'><a href='/'>My blog</a></div><div class='navigation'><ul><li><a href='/x'>Older</a></li><li><a href='/y'>Newer</a></li></ul></div><div class='post hentry'><h2>Baking bread at home</h2><div class='entry-content'><p>Flour, water, salt and time are all it takes to bake a good loaf at home.</p><p>Let the dough rest overnight. It gains taste and is easier to shape.</p></div></div><div id='comments'><h3>2 comments</h3><ol><li><div class='comment'><p>Great, I tried it yesterday and it worked!</p></div></li><li><div class='comment'><p>Which flour do you use?</p></div></li></ol></div><div id='sidebar' class='widget'><h3>Recent posts</h3><ul><li><a href='1'>Soup</a></li><li><a href='2'>Salad</a></li></ul></div></div>", ["Baking bread at home", "Flour, water, salt and time are all it takes to bake a good loaf at home.", "Let the dough rest overnight. It gains taste and is easier to shape."]),
    "main and sections": ("<body><div class='cookie-banner'><p>We use cookies to make this site better.</p><button>Accept</button></div><nav class='topnav'><a href='/'>Start</a><a href='/s'>Sport</a></nav><main><section><h1>A new bridge for the town</h1><p>After ten years of planning the council has agreed on a bridge of steel.</p><div class='advertisement'><p>Buy two pairs and get one free today.</p></div><p>Work begins in spring and takes about three years, the mayor said.</p></section></main><aside class='related'><h4>More stories</h4><ul><li><a href='b'>Old bridge closes</a></li></ul></aside><footer><p>All rights reserved.</p></footer></body>", ["A new bridge for the town", "After ten years of planning the council has agreed on a bridge of steel.", "Work begins in spring and takes about three years, the mayor said."]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_hand_written_pages_of_other_shapes(name):
    page, want = SHAPES[name]
    got = html_extract.main_text(page, html_extract.trained()).split("\n")
    assert sum(w in got for w in want) >= len(want) - 1 and sum(g not in want for g in got) <= 1, got
