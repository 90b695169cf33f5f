"""Quality rules, personal data, main text, top-k search."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulescope.llm import html_text, pii, quality_rules, topk_search
from tests.llm import brute

# --- op10 ---


def test_base_counts(odd_docs, odd_rows, real_docs, real_rows, no_docs):
    for df, rows in ((odd_docs, odd_rows), (real_docs, real_rows)):
        got = sorted(map(tuple, quality_rules.assess(df).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
        ).collect()))
        assert got == sorted((r[0], *brute.quality(r[1] or "")) for r in rows)
    assert quality_rules.assess(no_docs).count() == 0


def test_repeated_words_with_a_large_vocabulary():
    rng = random.Random(1)
    words = [f"w{rng.randrange(9000)}" for _ in range(12_000)]
    words += words[50:90]
    assert quality_rules.repeated_words([w.encode() for w in words]) == brute.quality(" ".join(words))[4]


def test_line_rules():
    rng = random.Random(2)
    prose = "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(12)) + "." for _ in range(6))
    assert quality_rules.judge(prose)[5:8] == (False, True, 0) and quality_rules.judge(prose)[8] == prose
    bars = " | ".join(f"x{i}" for i in range(40))
    assert quality_rules.judge(bars)[5:7] == (False, False)
    assert quality_rules.clean_lines(prose + "\n" + bars)[0] == prose
    shout = " ".join(f"W{i}!!" for i in range(40))
    assert quality_rules.judge(shout)[5:7] == (False, False)
    assert quality_rules.clean_lines("\n" + prose + "\n\n" + shout + "\n\n" + prose[:40])[0] == "\n" + prose + "\n\n\n" + prose[:40]
    # Base failures are never kept; short texts fail.
    assert quality_rules.judge("")[5:7] == (True, False) and quality_rules.judge("a b c")[5:7] == (True, False)
    # Words are counted alike before and after: a no-break space is no white space.
    wide = "\n".join(f"a{i}\u00a0b{i}\u3000c{i} d{i} e{i} f{i}" for i in range(9)) + "\n" + bars[:60]
    assert quality_rules.clean_lines(wide)[1] == 9 * 4


RECIPE = "Pancakes\n\nflour\nmilk\neggs\nsugar\nbutter\nsalt\n\nMix it all and fry it in a hot pan until it is brown."
POEM = "The night is long\nthe road is far\nand over all\na single star\n\nI walk alone\nand never rest\nthe wind goes north\nthe moon goes west"


def test_lists_verse_and_blank_lines_stay():
    for text in (RECIPE, POEM):
        assert quality_rules.judge(text)[5:] == (False, True, 0, text)
    bars = " | ".join(f"x{i}" for i in range(9))
    assert quality_rules.clean_lines(RECIPE + "\n" + bars)[0] == RECIPE


def test_line_hash_is_sparks(spark):
    lines = ["", "a", "Wir verwenden Cookies", "é日本\U0001f600 " * 9, "x" * 500]
    df = spark.createDataFrame([(x,) for x in lines], "s string").select("s", F.xxhash64("s").alias("h"))
    assert all(r.h == quality_rules.line_hash(r.s) for r in df.collect())


def _prose(rng: random.Random) -> str:
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + "."


def test_lines_that_recur_in_a_source_are_furniture(spark):
    """Banners in any language, by source; copies do not make lines recur."""
    rng = random.Random(11)
    banner = ["Wir verwenden Cookies, um Ihnen das beste Erlebnis zu bieten.", "Startseite", "Impressum"]
    rows = [(i, "\n".join([banner[1], _prose(rng), banner[0], banner[2]]), "host1") for i in range(40)]
    rows += [(100 + i, "\n".join([_prose(rng), "Startseite" if i < 5 else f"Teil {i}", _prose(rng)]), "host2") for i in range(40)]
    same = "\n".join([RECIPE, _prose(rng)])
    rows += [(200 + i, same, "host1") for i in range(60)]  # exact copies
    other = _prose(rng).split()
    for i in range(60):  # edited copies
        words = [f"edit{i}" if k == i % 50 else w for k, w in enumerate(other)]
        rows.append((300 + i, "\n".join([POEM, RECIPE, " ".join(words)]), "host2"))
    rows += [(400, "\n".join(banner), "host1"), (401, POEM, "host1"), (402, None, None), (403, RECIPE, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: r for r in quality_rules.assess(df).collect()}
    for i, text, source in rows[:40]:
        assert got[i].kept and got[i].cleaned == text.split("\n")[1] and got[i].n_lines_removed == 3
    for i, text, _ in rows[40:]:
        assert i == 400 or (got[i].kept, got[i].cleaned) == (text is not None, text or ""), i
    assert not got[400].kept
    out = {r.doc_id: r.text for r in quality_rules.cleaned(df).collect()}
    assert out == {i: r.cleaned for i, r in got.items() if r.kept}
    # Without a source column the table is one source.
    one = {r.doc_id: r.cleaned for r in quality_rules.assess(df.drop("source")).collect()}
    assert one[0] == got[0].cleaned and one[401] == POEM


def test_menus_longer_than_the_text_are_counted_exactly(spark):
    """Every page is a body of its own, however much of it is the menu."""
    rng = random.Random(12)

    def pages(source: str, first: int, n: int) -> list[tuple]:
        menu = [" ".join(f"{source}{rng.randrange(5000)}" for _ in range(10)) for _ in range(4)]
        own = [" ".join(f"w{rng.randrange(5000)}" for _ in range(25)) for _ in range(n)]
        return [(first + i, "\n".join([*menu, t]), source) for i, t in enumerate(own)]

    rows = [*pages("a", 0, 40), *pages("b", 100, quality_rules.RECUR_DOCS), *pages("c", 200, quality_rules.RECUR_DOCS - 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: (r.kept, r.cleaned) for r in quality_rules.assess(df).collect()}
    assert got == {i: (True, t if s == "c" else t.split("\n")[-1]) for i, t, s in rows}


def test_labelled_good_documents_are_kept(spark, real_rows):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    verdicts = [(labels[d], quality_rules.judge(t)) for d, t in real_rows if d in labels]
    assert all(v[6] for good, v in verdicts if good and not v[5])
    bad = [v[6] for good, v in verdicts if not good]
    assert not bad or sum(bad) <= 0.1 * len(bad)


def test_cleaned_keeps_columns(odd_docs, odd_rows):
    out = quality_rules.cleaned(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in odd_rows if quality_rules.judge(r[1] or "")[6])


# --- op8 ---


def spans(text: str) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(text))


def odd_numbers() -> list[tuple[int, str]]:
    rng = random.Random(2)
    parts = ["1", "2", "9", "0", ".", "-", " ", "+", "(", ")", "@", "a", "é", "\U0001f600", "%", "\n", "4111111111111111",
             "255", "256", "00", "a@b.c", "1.2.3.4", "+1 (555) 123-4567"]
    rows = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    return [*rows, (5000, "1 " * 20_000), (5001, "a" * 50_000 + "@"), (5002, "1.2.3.4 " * 600 + "+1" * 900)]


def test_base_spans_and_extra_spans(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows] + odd_numbers()
    df = odd_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(odd_numbers(), "doc_id long, text string").repartition(4)
    )
    got = {r.doc_id: r for r in pii.counts(pii.find(df)).collect()}
    for d, t in rows:
        want = brute.pii(t or "")
        assert got[d].base_sha256 == hashlib.sha256(spans(t or "").encode()).hexdigest(), t
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        every = got[d].spans.split(",") if got[d].spans else []
        assert set(spans(t or "").split(",")) - {""} <= set(every)
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in every)]
        assert order == sorted(order)
    assert pii.find(no_docs).count() == 0


def test_personal_data_beyond_the_base_rules(spark, real_docs):
    taken = [
        ("please ring (212) 555-0100 today", "phone:12:26"), ("ring 312-555-0147 now", "phone:5:17"),
        ("phone 0301234567 at noon", "phone:6:16"), ("to jo.doe (at) example.com.", "email:3:26"),
        ("ann [at] uni.de wrote", "email:0:15"), ("visa 378282246310005 ok", "card:5:20"),
        ("card 30569309025904 ok", "card:5:19"), ("card 4222222222222 ok", "card:5:18"),
        ("paid by 4111.1111.1111.1111", "card:8:27"), ("ip 10,0,0,1 is down", "ip:3:11"),
    ]
    others = [
        "order 0301234567 of", "on 2024-01-15 10 we met", "isbn 978-3-16-148410-0", "let us meet (at) noon", "look @ this",
        "serial 0300233469491448", "number 123-45-6789", "version 256.1.2.300 is", "list 10,20,30,40", "pi is 3.14159265",
    ]
    rows = [(10**6 + i, t) for i, t in enumerate([t for t, _ in taken] + others)]
    df = real_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in pii.counts(pii.find(df)).where("doc_id >= 1000000").collect()}
    assert [got[d] for d, _ in rows] == [s for _, s in taken] + [""] * len(others)
    alone = spark.createDataFrame(rows[:1], "doc_id long, text string")
    assert [r.text for r in pii.masked(alone).collect()] == ["please ring [PHONE] today"]


def test_every_document_counts_in_the_fit(spark):
    """No sample: 6,000 documents give 6,000 negatives, and so do rows without id."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 100 > 0, F.col("id")).alias("doc_id"),
        F.concat(F.lit("serial 0300233469491448 of "), F.col("id").cast("string")).alias("text"),
    )
    seen = pii.answers(rows).where("seen")
    by_part = {r.held: r.n for r in seen.groupBy("held").agg(F.sum("weight").alias("n")).collect()}
    assert sum(by_part.values()) == 6000 and 900 < by_part[True] < 1500
    assert seen.count() == 2  # counted, not listed: the fit's rows do not grow with the table
    margin, least = pii.fit(rows)
    assert "CASE" in margin and all(math.isfinite(x) for x in least)


def test_trees_become_sql(spark):
    debug = """GBTClassificationModel: uid = x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 4 <= 10.5)
     If (feature 7 <= 0.5)
      Predict: -1.0
     Else (feature 7 > 0.5)
      Predict: 0.5
    Else (feature 4 > 10.5)
     Predict: 1.0
  Tree 1 (weight 0.1):
    Predict: 2.0E-1
"""
    sql = pii.tree_sql(debug, "")
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 1.0), (11.0, 0.0)], "f_length double, f_plus double")
    assert [round(r[0], 6) for r in df.select(F.expr(sql)).collect()] == [-0.98, 0.52, 1.02]


def test_masked_text(spark):
    text = "write to a.b@c.de from 1.2.3.4 \U0001f600 card 4111 1111 1111 1111."
    rows = [(1, text, len(text), "r"), (2, "clean", 5, "r"), (3, None, None, "r"), (4, "", 0, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string")
    out = {r.doc_id: r for r in pii.masked(df).collect()}
    assert out[1].text == "write to [EMAIL] from [IP] \U0001f600 card [CARD]." and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[3].n_chars, out[4].text) == ("clean", None, None, "")
    assert pii.masked(df).columns == df.columns


def test_matches_in_many_chunks(spark):
    text = "ab1 " * 1000
    hits = spark.range(1).select(pii.matches(F.lit(text), "[0-9]").alias("h")).first()["h"]
    assert [(h["start"], h["end"]) for h in hits] == [(4 * i + 2, 4 * i + 3) for i in range(1000)]


SPANS = "array<struct<k:int,start:int,end:int,m:double>>"


def plain_cleared(scored: list, base: list) -> list:
    def rank(x):
        return -x[3], x[1], -x[2], x[0]

    def meet(x, y):
        return x[1] < y[2] and y[1] < x[2]

    kept = [x for x in scored if not any(meet(x, b) for b in base)]
    return [x for x in kept if not any(meet(x, y) and rank(y) < rank(x) for y in scored)]


def plain_redacted(text: str, spans: list) -> str:
    out, at = [], 0
    for start, far, k in sorted((s, -e, k) for k, s, e, *_ in spans):
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, -far)
    return "".join(out) + text[at:]


def test_choice_among_overlapping_spans(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        size = rng.choice([5, 30, 200])
        spans = {
            (rng.randrange(4), a, a + rng.randrange(1, 12), float(rng.randrange(4)))
            for a in (rng.randrange(size) for _ in range(rng.choice([0, 1, 4, 60])))
        }
        scored = sorted(spans, key=lambda x: rng.random())
        base = [(x[0], x[1], x[2], 0.0) for x in scored if rng.random() < 0.1]
        text = "".join(rng.choice("aé\U0001f600 ") for _ in range(size + 12))
        rows.append((i, scored, base, text))
    df = spark.createDataFrame(rows, f"id int, scored {SPANS}, base {SPANS}, text string").repartition(2)
    monkeypatch.setattr(pii, "_CHUNK", 7)  # runs that go on over the ends of pieces
    found = df.select("id", pii.cleared(F.col("scored"), F.col("base")).alias("c"), pii.redacted(F.col("text"), F.col("scored")).alias("r"))
    got = {r.id: (sorted((x.k, x.start, x.end, x.m) for x in r.c), r.r) for r in found.collect()}
    for i, scored, base, text in rows:
        # A base span is found again among the scored ones of equal place: none of those stays.
        assert got[i] == (sorted(plain_cleared(scored, base)), plain_redacted(text, scored)), i


def test_very_many_spans_in_one_text(spark):
    """The work grows with the spans, not with their square."""
    import re
    import time

    def seconds(n: int) -> float:
        text = ", ".join(f"(0{i % 900 + 100}) {i % 9000 + 1000:04d} 5555" for i in range(n))
        spans = [(3, m.start(), m.end(), 1.0) for m in re.finditer(r"\([0-9]+\) [0-9]+ [0-9]+", text)]
        assert len(spans) == n
        df = spark.createDataFrame([(text, spans)], f"text string, scored {SPANS}").repartition(1)
        start = time.perf_counter()
        clear = F.size(pii.cleared(F.col("scored"), F.expr(f"cast(array() as {SPANS})")))
        row = df.select(clear.alias("n"), pii.redacted(F.col("text"), F.col("scored")).alias("r")).first()
        assert row.n == n and row.r == ", ".join(["[PHONE]"] * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 10


def test_main_path_runs_no_python(real_docs):
    df = pii.counts(pii.find(real_docs))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- op3 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>
<div class="cookie-notice">We use cookies so that this long notice looks like an ordinary paragraph of text.</div>
%s
<aside><p>A long sidebar paragraph that could well be taken for content by its ratio alone.</p></aside>
<section id="comments"><article class="comment"><p>First! I am a reader with a long opinion about all of this.</p></article></section>
<form><label>Name</label><input name=n><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""
BODY = """<h1>Title &amp; more</h1><p>A first   paragraph\nwith <a href=x>a link</a>, long enough.</p><p>Short.</p>
<ul><li>item one<li>item two</ul><div class="ad">Buy this long advert text now, it is very cheap.</div>
<p>Last &lt;one&gt; of the article,<br>broken &#8212; here.</p>"""
WANT = [
    "Title & more", "A first paragraph with a link, long enough.", "Short.", "item one", "item two",
    "Last <one> of the article, broken — here.",
]


@pytest.mark.parametrize(
    "wrap", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="has-sidebar"><div id="content">%s</div></div>']
)
def test_main_text_without_furniture(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)).split("\n\n") == WANT


def test_layouts_without_one_article():
    def prose(n: int, word: str) -> str:
        return (f"The {word} is a part of this page. " * n)[:n].strip() + "."

    a, b, c = prose(600, "first"), prose(400, "second"), prose(300, "third")
    for page in (
        f"<div><section><p>{a}</p></section><section><p>{b}</p></section></div>",
        f"<div><div><div><p>{a}</p></div></div><div><p>{b}</p></div></div>",
        f"<div><p>{a}</p><ul><li>{b}</li></ul></div>",
        f"<div><p>{b}</p><ol><li>{a}</li></ol></div>",
        f"<div><p>{b}</p><table><tbody><tr><td>{a}</td></tr></tbody></table></div>",
        f"<div><p>{b}</p><blockquote><p>{a}</p></blockquote></div>",
        f"<div><p>{b}</p><pre>{a}</pre></div>",
        f"<div><article><p>{a}</p></article><article><p>{b}</p></article></div>",
        f"<main><article><p>{a}</p></article><article><p>{b}</p></article></main>",
    ):
        first, second = sorted((a, b), key=page.find)
        assert html_text.main_text(PAGE % page).split("\n\n") == [first, second], page
    three = f"<article><p>{a}</p></article><article><div><p>{b}</p></div></article><article><section><p>{c}</p></section></article>"
    assert html_text.main_text(PAGE % three).split("\n\n") == [a, b, c]


def test_linked_lines_of_an_article_stay():
    prose = "A long paragraph of the article that says something of substance. " * 5
    rest = '<h3><a href="/s">A linked subheading</a></h3><ul><li><a href="/1">First source</a><li><a href="/2">Second source</a></ul>'
    want = [prose.strip(), "A linked subheading", "First source", "Second source"]
    assert html_text.main_text(PAGE % f"<article><p>{prose}</p>{rest}</article>").split("\n\n") == want
    alone = '<h3><a href="/s">A linked subheading</a></h3><ul><li><a href="/1">First source</a></ul>'
    assert html_text.main_text(PAGE % f"<div><p>{prose}</p>{alone}<p>{prose}</p></div>").split("\n\n") == [*want[:3], prose.strip()]
    # A run of links outside an article or main is a menu.
    assert html_text.main_text(PAGE % f"<div><p>{prose}</p>{rest}</div>").split("\n\n") == want[:2]


LONG = " ".join(f"<p>Paragraph {i} of a long article that says something of substance.</p>" for i in range(8))
LONG_WANT = [f"Paragraph {i} of a long article that says something of substance." for i in range(8)]


@pytest.mark.parametrize(
    "page",
    [
        '<html><body class="single comments-open"><div id="c">%s</div></body></html>',
        '<html><body id="menu" class="has-sidebar hidden-nav"><article>%s</article></body></html>',
        '<html><body><article class="post comments-open">%s</article></body></html>',
        '<html><body><main id="main-menu-page" class="share">%s</main></body></html>',
        '<html><body><div class="content-with-sidebar">%s</div></body></html>',
        '<html><body><div class="page-no-menu">%s</div></body></html>',
        '<html><body><div class="layout-sidebar"><article>%s</article></div></body></html>',
        '<html><body><div class="layout-sidebar"><h1>T</h1>%s</div></body></html>',
        '<html><body><div class="related">%s</div></body></html>',
        '<html><body><form id="aspnetForm" method="post"><div>%s</div></form></body></html>',
        '<html><body><form><article>%s</article><p><label>Q</label><input><button>Go</button></p></form></body></html>',
        '<html><body><div><a href="/x">Skip<div><p>x</p></div><div>%s</div></div></body></html>',
        '<html><body><div><p><a name="top">%s</div></body></html>',
        '<html><body><header class="banner" role="banner"><main>%s</main></header></body></html>',
        '<html><body><div id="comments-wrap"><main>%s</main></div></body></html>',
        "<html><body><div><header>%s</header></div></body></html>",
    ],
)
def test_no_layout_loses_the_page(page):
    """Containers named after something beside the text, forms around the
    page, links without an end."""
    got = html_text.main_text(page % LONG).split("\n\n")
    assert [x for x in got if x.startswith("Paragraph")] == LONG_WANT
    assert set(got) - set(LONG_WANT) <= {"T", "x", "Skip"}


def test_furniture_that_is_longer_than_the_article():
    notes = "".join(f"<div class='comment'><p>Reader {i} has a long opinion about every part of this.</p></div>" for i in range(30))
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>An entry of the menu, number {i}</a></li>" for i in range(60)) + "</ul>"
    side = "<p>" + "A sidebar with one very long paragraph. " * 40 + "</p>"
    for before, after in (
        ("", f"<section id='comments'>{notes}</section>"),
        (f"<nav>{menu}</nav>", f"<div class='comments'><h2>Replies</h2>{notes}</div>"),
        (f"<div class='menu'>{menu}</div>", f"<aside>{side}</aside>"),
        (f"<div class='cookie-notice'>{side}</div>", f"<div class='sidebar'>{side}</div>"),
        ("", f"<article class='comment even'>{side}</article><article id='comment-7'>{side}</article>"),
    ):
        page = f"<html><body>{before}<article><h1>T</h1>{LONG}</article>{after}</body></html>"
        assert html_text.main_text(page).split("\n\n") == ["T", *LONG_WANT]


def test_headers_of_articles_and_controls_in_sentences():
    lead = "This standfirst tells in one sentence what the article is about."
    head = f"<header><p class='byline'>By A. Writer and some more words to make it long</p><h1>T</h1><p>{lead}</p><p>3 May</p></header>"
    page = f"<article>{head}{LONG}<p>Press the <button>Save</button> button.</p><button>Share</button><p><label>Name</label></p></article>"
    assert html_text.main_text(PAGE % page).split("\n\n") == ["T", lead, *LONG_WANT, "Press the Save button."]


def test_furniture_inside_a_line():
    page = f"<article>{LONG}<p>Before <script>var x = '<p>';</script>and <span class='share'>Tweet</span>after.</p></article>"
    assert html_text.main_text(PAGE % page).split("\n\n") == [*LONG_WANT, "Before and after."]


def test_broken_pages():
    assert html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("just text, no markup at all") == "just text, no markup at all"
    assert html_text.main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert html_text.main_text('<article><p>Cut off in a tag</p><a href="x') == "Cut off in a tag"
    assert html_text.main_text("<article><p><b>Never closed<br><p>Next &am") == "Never closed\n\nNext &am"
    assert html_text.main_text("<p>" * 5000 + "deep" + "<div>" * 3000 + "er") != ""


def test_pages_of_tables(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>Hello there.</p></article>", "x")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", ""), (2, None, ""), (3, "u", "Hello there.")] * 2, key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_whole_articles_of_real_pages(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        body = re.sub(r"<[A-Za-z/!][^<>]*\Z", "", body[1]) if body else ""
        parts = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts]
        assert html_text.main_text(r.html) == "\n\n".join(t for t in texts if t)


# --- op2 ---


def vectors(seed: int, n: int, dim: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(dim)], "x", 0) for i in range(n)]
    rows += [(n, None, "x", 0), (n + 1, [], "x", 0), (n + 2, [1.0, None] + [0.0] * (dim - 2), "x", 0),
             (n + 3, [math.nan] + [0.0] * (dim - 1), "x", 0), (n + 4, [math.inf] * dim, "x", 0), (None, [1.0] * dim, "x", 0)]
    return rows


def best(rows: list[tuple], k: int, every: int) -> list[tuple]:
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "k", "block"), [(120, 20, 4096), (120, 7, 3), (10, 20, 4096), (1, 5, 4096)])
def test_top_k_with_ties(spark, n, k, block):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score int").repartition(3)
    got = topk_search.top_k(df, F.col("vec_id") % 5 == 0, k, block=block)
    assert sorted(map(tuple, got.collect())) == best([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v, *_ in rows], k, 5)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.lit(True), 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(one, F.col("vec_id") % 2 == 0, 3).count() == 0
