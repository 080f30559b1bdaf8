import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import html_cut, url_rules
from panelcast.llm.queries_pages import URL_RULES, labelled_urls

WEIGHTS = np.array([0.5, -4.0, 0, 1, 1, 1, -1, -0.5, -4, -1, -1.5])


def cost(labels, unary, edges):
    return sum(-u for u, x in zip(unary, labels, strict=True) if x) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_minimum_cut_is_the_best_labelling():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 8)
        unary = [draw.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, draw.uniform(0, 2)) for i in range(n) for j in range(i) if draw.random() < 0.6]
        best = min(cost(x, unary, edges) for x in itertools.product([False, True], repeat=n))
        assert cost(html_cut.minimum_cut(unary, edges), unary, edges) == pytest.approx(best)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav><footer>f</footer>", ""),
        ("<article><h1>T&amp;t</h1><p>a<b>b</b> c\n d<br>e<p>f</article>", "T&t ab c d e f"),
        ("<article>x<aside>no</aside><script>if(a<b){'</p>'}</script><form>no<input></form>y</article>", "x y"),
        ("<main><p>kept text.</p><div class='comments'><p>no</p></div></main><div id=sidebar>no</div>", "kept text."),
        ("<article class='comment'>no</article><article><p>yes, this.</p></article>", "yes, this."),
        ("<article><!-- <p>no</p> --><p title='a>b'>1 &lt; 2 &#233; &nbsp; x</p></article", "1 < 2 é x"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    ],
)
def test_main_text(page, text):
    assert html_cut.main_text(page, WEIGHTS) == text


@pytest.fixture(scope="module")
def trained(spark):
    return html_cut.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


STORY = [f"This is sentence number {i} of a long story, with enough words to read like prose." for i in range(20)]


def test_a_teaser_marked_as_article_does_not_hide_the_story(trained):
    """The page's mark of its article is one cost among others."""
    page = "<article><a href=x>Teaser</a> <a href=y>Read on</a></article><div>" + "".join(f"<p>{s}</p>" for s in STORY) + "</div>"
    text = html_cut.main_text(page, trained)
    assert all(s in text for s in STORY)


def test_neighbours_decide_about_weak_blocks(trained, monkeypatch):
    """A short line that its own features would drop stays between paragraphs of the story, and goes
    between links; without smoothness edges both are judged alike."""
    line = "<div>Part two</div>"
    kept = "<div>" + f"<p>{STORY[0]}</p>" + line + f"<p>{STORY[1]}</p></div>"
    links = "<div><div><a href=a>Home page</a></div>" + line + "<div><a href=b>All pages</a></div></div>"
    calls = []
    flow = html_cut._flow
    monkeypatch.setattr(html_cut, "_flow", lambda *a: calls.append(1) or flow(*a))
    assert "Part two" in html_cut.main_text(kept, WEIGHTS)
    assert "Part two" not in html_cut.main_text(links, WEIGHTS)
    monkeypatch.setattr(html_cut, "_edges", lambda found: [])
    alone = ["Part two" in html_cut.main_text(p, WEIGHTS) for p in (kept, links)]
    assert alone[0] == alone[1]


def test_the_flow_settles_what_persistency_leaves():
    calls = []
    unary = [0.6, -0.5, 0.6, -0.5, 0.2]
    edges = [(i, i + 1, 1.0) for i in range(4)]
    labels = html_cut.minimum_cut(unary, edges)
    best = min(itertools.product([False, True], repeat=5), key=lambda x: cost(x, unary, edges))
    assert tuple(labels) == best and not calls


@pytest.mark.parametrize("open_tag", ["<a " + " ".join(f'k{i}="v"' for i in range(4000)), "<a " + "\"'" * 4000, "<a title=\"x" * 3000])
def test_a_truncated_tag_takes_no_time(open_tag):
    start = time.perf_counter()
    assert "kept text" in html_cut.main_text(f"<article><p>kept text here.</p></article>{open_tag}", WEIGHTS)
    assert time.perf_counter() - start < 2


def test_a_quote_that_never_closes():
    assert html_cut.main_text("<article><p title=\"x>one</p><p>two.</p></article>", WEIGHTS) == "one two."


def test_extract_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("text", F.lit("old"))
    out = html_cut.extract(pages, html_cut.train(pages))
    assert out.count() == pages.count() and out.where("text = '' AND html LIKE '%<h1>%'").count() == 0
    none = pages.limit(0)
    assert html_cut.extract(none, html_cut.train(none)).count() == 0


def test_very_long_page():
    page = "<article>" + "<div>" * 500 + "<p>word &amp; word</p>" * 5000 + "</article>" + "<" * 5000
    assert html_cut.main_text(page, WEIGHTS).count("word & word") == 5000


def urls():
    draw = random.Random(6)
    rows = []
    for i in range(600):
        host = draw.choice(["good.net", "pills.net", "pills.org", "mixed.org"])
        lang = draw.choice(["en", "de"])
        bad = host.startswith("pills") or (host == "mixed.org" and lang == "de")
        rows.append((i, f"http://www.{host}/{lang}/{draw.randint(1, 99)}", None if i % 4 == 0 else bad != (draw.random() < 0.05)))
    return rows


def token_set(url):
    host, _, rest = url.partition("://")[2].partition("/")
    lang, number = rest.split("/")
    return frozenset([f"host:{p}" for p in host.split(".")] + [f"path:{lang}", "path:#"])


def brute_rules(rows):
    known = [(token_set(u), b) for _, u, b in rows if b is not None]
    n, bad = len(known), sum(b for _, b in known)
    both, counts = Counter(), Counter()
    for t, b in known:
        for k in range(1, len(t) + 1):
            for items in itertools.combinations(sorted(t), k):
                counts[items] += 1
                both[items] += b
    least = max(url_rules.MIN_SUPPORT * n, url_rules.MIN_COUNT)
    good = [
        set(i) for i, c in both.items()
        if c >= least and c >= url_rules.MIN_CONFIDENCE * counts[i] and c * n >= url_rules.MIN_LIFT * counts[i] * bad
    ]
    return {tuple(sorted(i)) for i in good if not any(j < i for j in good)}


def test_mined_rules_equal_brute_force(spark):
    rows = urls()
    df = spark.createDataFrame(rows, "page_id int, url string, bad boolean")
    rules = url_rules.mine(df)
    want = brute_rules(rows)
    assert want and {tuple(r["items"]) for r in rules.collect()} == want
    more = [(9001, None, None), (9002, "no scheme/en", None), (9003, rows[0][1], None), (9003, rows[0][1], None)]
    pages = df.unionByName(spark.createDataFrame(more, df.schema)).withColumn("host", F.lit("old"))
    out = url_rules.judge(pages, rules).collect()
    assert len(out) == len(rows) + 4
    for r in out:
        fits = r["url"] and "://" in r["url"] and any(set(i) <= token_set(r["url"]) for i in want)
        assert r["verdict"] == ("block" if fits else "allow") and r["rule"] is None
    none = url_rules.mine(df.where("bad IS NULL"))
    assert none.count() == 0 and url_rules.judge(pages.limit(0), none).count() == 0


def test_rules_of_the_given_pages_hold_on_held_out_urls(spark):
    rows = labelled_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"))
    rules = url_rules.mine(rows.where("NOT held_out"))
    assert rules.count() >= 3
    n, share = url_rules.precision(rows.where("held_out"), rules)
    assert n >= 100 and share >= url_rules.MIN_CONFIDENCE


def test_any_other_column_name_may_be_in_use(spark):
    df = spark.createDataFrame([("x://b.net/en/1", "h", "r", 7, "t")], "url string, hit_url string, rule string, confidence int, tokens string")
    rules = url_rules.mine(df.select("url", F.lit(None).cast("boolean").alias("bad")))
    (row,) = url_rules.judge(df, rules, URL_RULES).collect()
    assert (row["hit_url"], row["confidence"], row["tokens"], row["rule"], row["verdict"]) == ("h", 7, "t", None, "allow")


def test_fixed_rules_and_parts(spark):
    cases = {
        "http://a.example.com/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.EXAMPLE.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://com/": ("com", "/", "com/", "allow"),
        "x://b.com": ("b.com", "", None, "allow"),
        "x://b.com?u=http://c.net/es/": ("b.com", "", None, "allow"),
        "x://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "x://m.b.net/fr/": ("m.b.net", "/fr/", "net/fr/", "block"),
        "none": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    rules = url_rules.mine(df.withColumn("bad", F.lit(None).cast("boolean")))
    for r in url_rules.judge(df, rules, URL_RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]]
