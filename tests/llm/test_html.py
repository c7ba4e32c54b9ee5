"""Main text of pages: block trees, decoding, layouts that were not learned from, and whole tables."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tideglass.llm import html_text
from tideglass.llm.dom import N_FEATURES, Page, features
from tideglass.llm.samples import MARK, compose

PROSE = "Rivers carry silt to the sea, and deltas grow where the current slows down. "
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul>"


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").cache()


@pytest.fixture(scope="module")
def trees(spark, pages):
    return html_text.fit(spark, html_text.sentences(pages, "html"))


def texts(spark, trees, sources):
    rows = spark.createDataFrame(list(enumerate(sources)), "page_id long, html string").selectExpr("*", "'u' AS url", "'x' AS text", "1 AS key")
    got = {r["page_id"]: r for r in html_text.extract(rows, trees=trees).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    return [got[i]["text"] for i in range(len(sources))]


def tree(source):
    page = Page(source)
    return [(t, page.tags[p]) for t, p in zip(page.tags[1:], page.parents[1:], strict=True)]


def test_block_trees():
    assert tree("<p>a<p>b<div>c</div>") == [("p", "#root"), ("p", "#root"), ("div", "#root")]
    assert tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", "#root"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("#text", "li"), ("li", "ul"), ("li", "ul")]
    assert tree("<table><tr><td>a<td>b<tr><td>c</table>x") == [("table", "#root"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"), ("#text", "#root")]
    assert tree("a<b>b<div>c</div>d") == [("div", "#root"), ("#text", "#root"), ("#text", "#root")]
    assert tree("<script>if (a</b>) '<p>'</script><style>p{}</style><!-- <p> --><title>t</title><p>x") == [("p", "#root")]
    assert tree("<head><title>t</title><meta x><body><p>x") == [("body", "#root"), ("p", "body")]


def test_texts_of_pages():
    say = lambda s: Page(s).text()
    assert say("<p>a&amp;b &lt;i&gt; &#233;&#x20AC;&nbsp;c</p>") == "a&b <i> é€ c"
    assert say("<p>fo<b>o</b>bar\n\n  baz<br>qux</p><p>end") == "foobar baz qux end"
    assert say("one<div>two</div>three") == "one two three" and say("<a href='x>y'>l</a> & < 3 <4") == "l & < 3 <4"
    assert say("") == "" and say("<") == "<"
    assert say("<p>" + "x" * 2_000_000 + "</p>") == "x" * 2_000_000 and len(say("<div>" * 5000 + "deep")) == 4
    assert say("<p>cut <b") == "cut <b" and say("<!-- never closed <p>x") == "" and say("<script>never closed") == ""


def test_features_of_any_page():
    rng = random.Random(1)
    parts = ["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "text ", "<a href=x>", "</a>", "<br>", "<h1 class='a b'>", "</h1>", "&amp;", "<form id=search>", "<", "</body>", "<body>", "<html>", "<span>"]
    for _ in range(500):
        page = Page("".join(rng.choices(parts, k=rng.randint(0, 40))))
        seen, rows = features(page, {})
        assert all(len(r) == N_FEATURES and np.isfinite(r).all() for r in rows) and len(set(seen)) == len(seen) == len(rows)
        assert all(page.parents[i] < i for i in range(1, len(page.tags)))
        assert (0 in seen) == bool(Page("".join(t for _, _, t, _ in page.texts)).text()) or not seen


def test_decoding_is_the_likeliest():
    """Against all labellings of small trees: one region, and article, not or mixed inside it."""
    rng = random.Random(7)
    for _ in range(150):
        page = Page("".join(rng.choices(["<div>", "</div>", "<p>x", "<ul>", "<li>y", "</ul>"], k=9)) + "<p>z")
        seen, _ = features(page, {})
        if len(seen) > 7:
            continue
        odds = dict(zip(seen, [rng.uniform(-3, 3) for _ in seen], strict=True))
        leaf = {i: all(page.parents[j] != i for j in seen) for i in seen}
        mixed, none = 0.7, 1.1
        above = lambda i: [i, *above(page.parents[i])] if i > 0 else [0]

        def cost(labels, region):
            total = 0.0
            for i in seen:
                chain = above(i)
                inside = region in chain
                if not inside and i in (above(region) if region is not None else []):
                    if labels[i] != "m":
                        return None
                    continue
                if not inside:
                    if labels[i] != "n":
                        return None
                elif labels[i] == "m":
                    if leaf[i] or i != region and labels[page.parents[i]] != "m":
                        return None
                    total -= mixed
                    continue
                elif i == region:
                    if labels[i] != "y":
                        return None
                elif labels[page.parents[i]] != "m" and labels[i] != labels[page.parents[i]]:
                    return None
                total += -np.log1p(np.exp(-odds[i] if labels[i] == "y" else odds[i]))
            return total - (none if region is None else 0)

        best = None
        for region in [*seen, None]:
            for combo in product("ynm", repeat=len(seen)):
                labels = dict(zip(seen, combo, strict=True))
                c = cost(labels, region)
                if c is not None and (best is None or c > best[0] + 1e-12):
                    best = c, {i for i in seen if labels[i] == "y"}
        keep = html_text.decode(page, seen, [odds[i] for i in seen], mixed, none)
        assert {i for i in seen if keep[i]} == best[1]


def test_log_odds_equal_the_model(spark, pages):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = html_text.examples(spark, ["One sentence. ", "Another one, longer than that. "], 30)
    got = rows.collect()
    feature, threshold, leaf = trees = html_text.fit(spark, ["One sentence. ", "Another one, longer than that. "], 30, 4, 3)
    assert feature.shape == (4, 7) and leaf.shape == (4, 8)
    model = GBTClassifier(weightCol="weight", maxIter=4, maxDepth=3, stepSize=0.2, maxBins=32, seed=12).fit(rows.select("label", "weight", array_to_vector("features").alias("features")))
    want = [r["rawPrediction"][1] for r in model.transform(rows.select("label", array_to_vector("features").alias("features"))).collect()]
    mine = html_text.log_odds(np.array([r["features"] for r in got]), trees)
    assert np.allclose(mine, np.clip(2 * np.array(want), -html_text.SURE, html_text.SURE))


def test_given_pages_exactly(spark, pages, trees):
    want = {r["page_id"]: Page("<body>" + re.search("(?s)<article>(.*)</article>", r["html"])[1]).text() for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages, trees=trees).collect()} == want


def test_layouts_that_were_not_learned_from(spark, trees):
    main = "<h1>Deltas</h1>" + "".join(f"<p>{PROSE * k}</p>" for k in (3, 1, 4, 2))
    want = "Deltas " + " ".join([PROSE.strip()] * 10)
    foot = "<footer><p>&copy; 2024 The Gazette. All rights reserved.</p>" + MENU + "</footer>"
    comments = "<section class='comments'><h2>2 comments</h2><div class='comment'><b>Ann</b><p>I have lived there for years and it is so.</p></div><div class='comment'><b>Bo</b><p>Nice read, thank you. I will share it.</p></div></section>"
    layouts = [
        f"<header class='site-header'><h1>The Gazette</h1><nav>{MENU}</nav></header><main><article>{main}</article></main><aside class='sidebar'><h3>Latest</h3>{MENU}</aside>{foot}",
        f"<div id='header'><a href=/>The Gazette</a></div><div id='nav'>{MENU}</div><div id='content'>{main}</div>{comments}<div id='footer'><p>All rights reserved.</p></div>",
        f"<div class='cookie-banner'><p>We use cookies to improve this site. By staying you agree to that.</p><button>OK</button></div><nav>{MENU}</nav><div class='wrapper'><div class='article-body'>{main}<div class='ad'>Buy our fine boots today.</div></div><div class='sidebar'><div class='widget'><h4>Most read</h4>{MENU}</div></div></div>{foot}",
        f"<nav>{MENU}</nav><article>{main}<div class='share'><a href=/t>Tweet</a> <a href=/f>Share</a></div><form class='newsletter'><p>Get our letter each week.</p><input><button>Sign up</button></form></article><div class='related'><h3>Related</h3>{MENU}</div>{comments}{foot}",
    ]
    assert texts(spark, trees, [f"<html><head><title>t</title></head><body>{x}</body></html>" for x in layouts]) == [want] * 4


def test_composed_pages_held_out(spark, pages, trees):
    said, right, f1 = html_text.sentences(pages, "html"), 0, []
    sources, want = [compose(i, said, seed=99) for i in range(400)], []
    for s in sources:
        page = Page(s)
        page.texts = [(a, b, t.replace(MARK, ""), d) for a, b, t, d in page.texts if MARK in t]
        want.append(page.text())
    for got, w in zip(texts(spark, trees, [s.replace(MARK, "") for s in sources]), want, strict=True):
        a, b = Counter(got.split()), Counter(w.split())
        f1.append(2 * (a & b).total() / max(1, a.total() + b.total()))
        right += got == w
    assert sum(f1) / 400 > 0.93 and right > 300


def test_empty_and_odd_pages(spark, trees):
    got = texts(spark, trees, [None, "", " ", "<html></html>", "<nav>" + MENU + "</nav>", "<article><p>" + "word " * 200_000 + "</p></article>"])
    assert got[:4] == [""] * 4 and got[5] == ("word " * 200_000).strip()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty, trees=trees).collect() == []
    assert html_text.sentences(empty, "html")
