"""HTML extraction: the parser against expected trees, the choice of nodes against all choices, and pages of layouts of which none was learned."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.compare import differences
from tremor.llm import dom, extraction, layouts, queries
from tremor.llm.common import table

P1 = "The city council approved a new budget on Tuesday, after months of debate over spending on roads and schools."
P2 = "Officials said the plan would take effect in July. Critics argued it does not go far enough, and that taxes will rise."
SAID = "I totally disagree with this article, the author has clearly never lived in this city and does not know what it is like to drive on those roads every day."


@pytest.fixture(scope="module")
def trees(spark, sf_dir):
    return extraction.learn_trees(table(spark, sf_dir, "pages"))


def blocks(page):
    nodes = dom.Pages()
    nodes.add(page)
    return [(tag, text) for tag, text in zip(nodes.tag, nodes.text, strict=True) if text]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp b<div>c<br>d<ul><li>x<li>y</ul>tail</div>", [("p", "a & b"), ("#text", "c d"), ("li", "x"), ("li", "y"), ("#text", "tail")]),
        ("<p>one<p>two</p></p>three", [("p", "one"), ("p", "two"), ("#text", "three")]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", [("td", "1"), ("td", "2"), ("th", "3")]),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", [("#text", "a"), ("li", "b"), ("#text", "c"), ("li", "d")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dt", "a"), ("dd", "b"), ("dt", "c")]),
        ("a<!-- <p>no</p> --><!--> b<script>if (a < b) '<p>'</SCRIPT >c<style>p{}</style>", [("#root", "a bc")]),
        ('<p title="a>b" data-x=\'>\'>t</p><a href=it\'s>u</a>', [("p", "t"), ("#text", "u")]),
        ("3 < 4 &lt; 5&nbsp;&#10; x &unknown; <", [("#root", "3 < 4 < 5 x &unknown; <")]),
        ("<p>a<b>b</p><div>c</b>d</div></section></p>", [("p", "ab"), ("div", "cd")]),
        ("<p>x</p><a href='y", [("p", "x")]),
        ("<p>x<button>no</button>y<button>z</p>", [("p", "xyz")]),
        ("<textarea><p>no</p></textarea><svg><text>no</text></svg><select><option>no</select>yes", [("#root", "yes")]),
        ("<DIV>A</DIV><hr>b<?php x ?>c<![CDATA[d]]>e</>f", [("div", "A"), ("#text", "bcef")]),
        ("", []),
        (None, []),
    ],
)
def test_parser(page, want):
    assert blocks(page) == want


def test_long_and_deep_pages_take_linear_time():
    for page in ("<div>" * 60_000 + "x", "<p>x" * 60_000, '<a "' * 200_000, "<script>" * 60_000, "<button>x" * 60_000, "</div>" * 100_000, "<!--" * 100_000, "&amp;" * 200_000, "<li>x</p>" * 60_000):
        nodes = dom.Pages()
        nodes.add(page)
        assert nodes.features().shape == (len(nodes.parent), dom.N_FEATURES)
        dom.kept_nodes(nodes.parent, [1.0] * len(nodes.parent))


def test_choice_is_the_best_without_contradictions():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        scores = [round(rng.uniform(-3, 3), 3) for _ in range(n)]
        allowed = [c for c in itertools.product((False, True), repeat=n) if c[0] and all(not c[i] or c[parents[i]] for i in range(1, n))]
        best = max(sum(s for s, k in zip(scores, c, strict=True) if k) for c in allowed)
        got = dom.kept_nodes(parents, scores)
        assert tuple(got) in allowed and sum(s for s, k in zip(scores, got, strict=True) if k) == pytest.approx(best)


UNSEEN = {
    "comments": (
        f'<body><header><div class=logo>Daily</div><nav><ul><li><a>Home</a></ul></nav></header><main><article class="post"><h1>Council passes budget</h1><p>{P1}</p><aside class="related"><h4>Related</h4><p>{SAID}</p></aside>'
        f'<blockquote>{P2}</blockquote><div class="ad-slot"><p>Buy our very nice shoes, now at half price, only today.</p></div><p>{P1}</p></article><section id="comments"><h2>Comments</h2><ul><li class="comment"><p>{SAID}</p></li>'
        f'<li class="comment"><p>{SAID}</p></li></ul><form><label>Your name</label><input><textarea>say</textarea><button>Send</button></form></section></main><footer><p>Terms and conditions apply to every reader of this site.</p></footer></body>',
        ["Council passes budget", P1, P2, P1],
    ),
    "cookie": (
        f'<body><div class="cookie-banner"><p>We use cookies to improve your experience on our site, to show you personalised ads, and to analyse traffic.</p><button>Accept</button></div><div class="navbar"><a>A</a><a>B</a></div>'
        f'<div id="content"><h2>Title here</h2><div class="entry-content">{P1}<br><br>{P2}<ul><li>First point of the plan.</li><li>Second point of the plan.</li></ul></div></div><div id="sidebar"><div class="widget"><h3>About</h3><p>{SAID}</p></div></div></body>',
        ["Title here", f"{P1} {P2}", "First point of the plan.", "Second point of the plan."],
    ),
    "newsletter": (
        f'<article><h1>T</h1><p>{P1}</p><form class="newsletter"><p>Sign up to our newsletter and get the best stories every day in your inbox.</p><input type=email><button>Go</button></form><p>{P2}</p>'
        f"<table><tr><th>Year</th><th>Cost</th></tr><tr><td>2023</td><td>5 million</td></tr></table></article><aside><p>{SAID}</p></aside>",
        ["T", P1, P2, "Year", "Cost", "2023", "5 million"],
    ),
    "plain": (f"<p>{P1}</p>", [P1]),
    "text": (P1, [P1]),
    "nothing": ("<nav><a>x</a><a>y</a></nav><footer>&copy; z</footer>", []),
}


@pytest.mark.parametrize("name", UNSEEN)
def test_unseen_layouts(trees, name):
    page, want = UNSEEN[name]
    assert extraction.extract([page], trees) == ["\n".join(want)]


def test_layouts_of_other_pages_are_told_apart(trees, spark):
    """Held-out pages (those of the larger table that the smaller one has not), in layouts drawn anew."""
    rng = random.Random(99)
    right = total = 0
    for r in table(spark, "/root/testdata/sf0.1", "pages").filter("page_id >= 2300").limit(120).collect():
        main, rest = layouts.taught_blocks(r.html)
        for _ in range(2):
            page = layouts.Layout(rng, main, rest).page()
            nodes = dom.Pages()
            nodes.add(page)
            want = [t.replace(layouts.MARK, "") for t in nodes.text if layouts.MARK in t]
            got = extraction.extract([page.replace(layouts.MARK, "")], trees)[0].split("\n")
            right += 2 * len(set(want) & set(got))
            total += len(set(want)) + len(set(got))
    assert right / total > 0.95


def test_matches_sql(spark, sf_dir):
    name = "op12_html_extraction"
    assert differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) == ""


def test_extraction_cases(spark, trees):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", f"<article><p>{P1}</article>", "x"), (3, "u", f"<article><p>{P1}</article>", "x"), (3, "u", f"<article><p>{P1}</article>", "x"), (4, "u", "<article>" + f"<p>{P2}" * 20_000, "x")]
    made = extraction.with_main_text(spark.createDataFrame(rows, schema), trees).orderBy(F.col("page_id").asc_nulls_last()).collect()
    assert [r["__text"] for r in made] == ["", "", P1, P1, "\n".join([P2] * 20_000), P1] and {r.text for r in made} == {"x"}
    few = spark.createDataFrame(rows[:2], schema)  # nothing to learn from
    assert [tuple(r) for r in extraction.extraction_report(few).collect()] == [(1, "u", "", 0), (2, None, "", 0)]
    assert extraction.extraction_report(spark.createDataFrame([], schema)).count() == 0
    assert extraction.extract([f"<div class=sidebar>x</div><p>{P1}"], None) == [P1]
