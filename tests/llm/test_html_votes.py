"""Operator 9: what a host repeats goes without being marked, and no text is lost around unwanted inline elements."""

import random

import pytest

from gatherline.llm import html_extract


@pytest.mark.parametrize("junk", [
    "<span class='share'>Share</span>", "<button>Go</button>", "<label>Tick</label>", "<span class=ad><b>buy</b></span>", "<a class='social' href=x>post</a>", "<i hidden>no</i>", "<span class=ad>left open<em>",
    "<em role=navigation>x</em>", "<input value=3>", "<select><option>1</select>",
])
def test_text_goes_on_after_inline_junk(junk):
    closed = junk + ("</span>" if junk.endswith("<em>") else "")
    page = html_extract.parse(f"<html><body><article><p>Alpha {closed} the rest, {closed}and more.</p><p>{closed} Beta</p><p>last</p></article></body></html>")
    assert html_extract.extract(page, []) == "Alpha the rest, and more.\nBeta\nlast"


def test_blocks_within_inline_junk_end_the_paragraph():
    page = html_extract.parse("<article><p>One</p>before <span class=ad><div>junk</div></span> after<p>two</p></article>")
    assert html_extract.extract(page, []) == "One\nbefore\nafter\ntwo"


def test_formulas_are_text():
    page = html_extract.parse("<article><p>Euler: <math><mi>e</mi><annotation encoding='application/x-tex'>\\e</annotation></math> is 2.7</p></article>")
    assert html_extract.extract(page, []) == "Euler: e is 2.7"


def test_what_a_host_repeats_goes(spark):
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(30))
    own = {i: [line(), line(), line()] for i in range(30)}
    page = lambda texts, tail: "<html><body><div class='c1'>" + "".join(f"<p>{t}</p>" for t in texts) + tail + "</div></body></html>"
    note = "<div class='c2'>Copyright of the house. All rights reserved, &amp; so on.</div>"
    rows = [(i, f"http://a.example/{i}", page(t, note)) for i, t in own.items()]
    copies = [line(), line()]  # a host of copies and near copies keeps its text
    rows += [(100 + i, f"http://b.example/{i}", page([*copies, f"tail {i}"], "")) for i in range(6)] + [(200 + i, "http://c.example/same", page(copies, note)) for i in range(5)]
    rows += [(300, "http://d.example/1", page(copies, note)), (301, "http://d.example/2", page(own[3], note)), (302, None, None)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(t) for i, t in own.items())
    assert all(got[100 + i] == "\n".join([*copies, f"tail {i}"]) for i in range(6))
    kept = "Copyright of the house. All rights reserved, & so on."
    assert got[200] == got[300] == "\n".join([*copies, kept]) and got[301] == "\n".join([*own[3], kept]) and got[302] == ""
