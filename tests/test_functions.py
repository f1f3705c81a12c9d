"""Golden values of the scalar columns, derived by hand from their definitions."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import links as L
from gleanery.functions import quality as Q
from gleanery.functions import ranking as R
from gleanery.functions import text as T
from gleanery.functions import url as U
from gleanery.functions.site import site_of


def column(spark, schema, values, expr):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalized(spark):
    given = ["HTTP://Ex.COM:80/A/?b=2&a=1&utm_source=x#f", "https://ex.com:443", "https://ex.com/p/?ref=1", "https://ex.com/p?k=", "ftp://ex.com/", "/rel", "mailto:a@b", None, "", "http://ex.com//", "http://e.com/a?x=a%20b&x=%7E*", "http://e.com/a?x=%zz"]
    want = ["http://ex.com/A?a=1&b=2", "https://ex.com/", "https://ex.com/p", "https://ex.com/p?k=", None, None, None, None, None, "http://ex.com", "http://e.com/a?x=a+b&x=~%2A", "http://e.com/a?x=%25zz"]
    got = column(spark, "u string", [(g,) for g in given], U.normalized(F.col("u")))
    assert got == want
    plain = [g for g in got if g and "?" not in g and g != "http://ex.com"]
    assert column(spark, "u string", [(g,) for g in plain], U.normalized(F.col("u"))) == plain


def test_skip(spark):
    given = ["http://e.com/login", "http://e.com/a/b/c/d/e", "http://e.com/a/b/c/d/e/f", "http://e.com/?a&b&c&d&e&f", "http://e.com/x/admin", "http://e.com/fine", "http://e.com/LOGOUT"]
    assert column(spark, "u string", [(g,) for g in given], U.skipped(F.col("u"))) == [True, False, True, True, True, False, True]
    only = U.UrlRules(whitelist=("/article",))
    assert column(spark, "u string", [("http://e.com/article/1",), ("http://e.com/x",)], U.skipped(F.col("u"), only)) == [False, True]


def test_resolved(spark):
    base = "http://e.com/a/b?q"
    given = ["http://x.org/", "//h.net/p", "/r", "c", "../d", "?z", "/x/../y", "mailto:a@b"]
    want = ["http://x.org/", "http://h.net/p", "http://e.com/r", "http://e.com/a/c", "http://e.com/d", "http://e.com/a/b?z", "http://e.com/y", "mailto:a@b"]
    assert column(spark, "h string", [(g,) for g in given], U.resolved(F.lit(base), F.col("h"))) == want


def test_site(spark):
    given = [("WWW.Ex.com:443.", "http://o.org/"), ("www.ex.com.", ""), (None, "https://www.A.b.c:80/x"), ("unknown", "http://u@h.com/"), ("docs.ex.com", ""), ("", "http://z.org"), (None, None)]
    assert column(spark, "d string, u string", given, site_of(F.col("d"), F.col("u")))[1:] == ["ex.com", "a.b.c", "h.com", "docs.ex.com", "z.org", ""]


MARKUP = """<html><head><title> A &amp; B </title><meta name="description" content="It's d"><link rel="canonical" href="/c"><meta name="robots" content="NoIndex, nofollow">
<script>var x = "</p>";</script><style>p{}</style></head><body><!-- <a href="/no"> --><h1>H</h1><p>one<b>two</b><a href='/x'>l</a><a href="">e</a><a href="#f">f</a><a class=k href="../y?a&amp;b">m</a></body></html>"""


def test_html(spark):
    one = lambda e: column(spark, "m string", [(MARKUP,)], e)[0]
    m = F.col("m")
    assert one(H.title(m)) == "A & B"
    assert one(H.text(m)) == "A & B H one two l e f m"
    assert one(H.dom_text(m)) == "A & B H one two l e f m"
    assert one(H.description(m, H.text(m))) == "It's d"
    assert one(H.hrefs(m)) == ["/x", "../y?a&b"]
    assert one(H.canonical(m)) == "/c"
    assert one(H.directives(m, F.lit("noarchive"))) == ["noarchive", "nofollow", "noindex"]
    assert column(spark, "m string", [("<p>x</p>",), ("<title></title>",)], H.title(m)) == ["No Title", ""]
    long = column(spark, "m string", [("x" * 201,)], H.description(m, m))[0]
    assert long == "x" * 200 + "..."


def test_length_score(spark):
    given = [0, 50, 99, 100, 200, 300, 500, 800, 1400, 2000, 3500, 5000, 9000]
    want = [0, 0.0667, 0.132, 0.2, 0.375, 0.55, 0.65, 0.8, 0.875, 0.95, 0.975, 1, 1]
    assert column(spark, "n int", [(g,) for g in given], Q.length_score(F.col("n"))) == pytest.approx(want, abs=1e-4)


def test_freshness_and_structure(spark):
    assert column(spark, "d int", [(None,), (-1,), (0,), (30,), (182,), (365,), (1000,)], Q.freshness(F.col("d"))) == pytest.approx([1, 1, 1, 0.9753, 0.8504, 0.7, 0.7], abs=1e-4)
    counts = Q.element_counts(F.col("m"))
    assert column(spark, "m string", [("<h1>a</h1><p>b</p><ul><li>c</li></ul>",)], Q.structure_score(counts)) == pytest.approx([0.35])
    assert column(spark, "m string", [("<pre>x</pre><label>y</label>",)], F.struct(counts["paragraphs"], counts["lists"]))[0] == (1, 1)


def test_density(spark):
    text = " ".join(["k"] * 100 + ["w"] * 900)
    got = column(spark, "t string, k array<string>", [(text, ["K"]), ("", ["k"]), (None, None), ("a b", []), ("a b", ["z"])], Q.density(F.col("t"), F.col("k")))
    assert got[0]["global_density"] == pytest.approx(0.1) and got[0]["max_density"] == pytest.approx(1.0) and got[0]["stuffing"] == pytest.approx(1.0)
    assert [tuple(g) for g in got[1:]] == [(0, 0, 0)] * 4


def test_readability(spark):
    t = F.col("t")
    assert column(spark, "t string", [(None,), ("short.",), ("!" * 60,)], Q.readability(t)) == [0, 0, 0]
    text = " ".join(["words"] * 17) + "."
    assert column(spark, "t string", [(text,)], Q.readability(t))[0] == pytest.approx(0.6 * (1 - 0.5 / 30) + 0.4 * (1 - abs(86 / 17 - 5) / 10))


def test_links(spark):
    assert column(spark, "d string", [("",), ("www.github.com",), ("en.wikipedia.org",), ("x.edu",), ("x.com",), ("x.com:8080",), ("x.xyz",), (None,)], L.domain_authority(F.col("d"))) == [0.2, 0.9, 0.7, 0.85, 0.6, 0.4, 0.4, 0.2]
    got = column(spark, "a string", [("",), ("click here",), ("CLICK HERE!!!",), ("excellent resource",), ("Read The Docs",), ("a short guide to spark",), (None,)], L.anchor(F.col("a"))["naturalness"])
    assert got == [0.3, 0.4, 0.2, 0.6, 0.2, 0.7, 0.3]
    assert column(spark, "n long", [(0,), (1,), (2,), (10,), (42,), (100,), (221,), (None,)], L.backlink_score(F.col("n"))) == pytest.approx([0, 0.2155, 0.2831, 0.4996, 0.7269, 0.8692, 1, 0], abs=1e-4)


@pytest.mark.parametrize(
    "links, inbound, overall, suspicious",
    [
        ([("wikipedia.org", "excellent resource"), ("github.com", "original implementation")], 50, 0.8238, False),
        ([(f"spam{i % 3}.xyz", "CLICK HERE!!!") for i in range(30)], 100, 1.6573, True),
        ([("a.com", "link from a.com")] * 4 + [("b.org", "link from b.org")], 5, 1.0607, False),
    ],
)
def test_link_quality(spark, links, inbound, overall, suspicious):
    b = spark.createDataFrame([("t", d, a, None) for d, a in links], "target_url string, domain string, anchor_text string, is_generic_anchor boolean")
    got = L.link_quality(b, spark.createDataFrame([("t", inbound)], "target_url string, inbound long")).first()
    assert got.overall == pytest.approx(overall, abs=1e-4) and got.suspicious is suspicious


@pytest.mark.parametrize("scores, want", [((0.05, 0.9, 0.85, 0.5), (0.93, 0.762, 0.735, 0.831)), ((0.2, 0.25, 0.9, 1.0), (0.162, 0.24075, 0.26175, 0.21675)), ((0.0, 0.5, 0.1, 0.25), (0.17375, 0.13625, 0.0575, 0.12625))])
def test_rank(spark, scores, want):
    df = spark.createDataFrame([scores], "pagerank double, panda_score double, penguin_score double, relevance_score double")
    got = df.select(*[R.rank_score(s) for s in ("content_first", "relevance_first", "authority_first", "balanced")]).first()
    assert tuple(got) == pytest.approx(want, abs=1e-6)
    assert df.select(R.rank_score("nonsense")).first()[0] == pytest.approx(want[3], abs=1e-6)


def test_tokens_and_stems(spark):
    assert column(spark, "t string", [("The well-known Cats, don't run. Étés x2 (dogs)",), (None,)], T.tokens(F.col("t"))) == [["cats", "run", "étés", "dogs"], []]
    for word, want in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "sky": "sky"}.items():
        assert T.porter(word) == want
    long = spark.createDataFrame([(1, "cats"), (2, "cat"), (3, None)], "doc_id long, term string")
    assert sorted(tuple(r) for r in T.with_stems(long).select("doc_id", "term").collect()) == [(1, "cat"), (2, "cat")]
