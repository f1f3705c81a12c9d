"""Index, graph, search, frontier, health, dedup, scale helpers, sources and streams on small inputs."""

import datetime as dt
import gzip
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gleanery.operators import frontier as P
from gleanery.operators import graph as G
from gleanery.operators import health as H
from gleanery.operators import index as I
from gleanery.operators import search as S
from gleanery.operators.scale import cut, join_counted, running_total
from gleanery.sources import crawl as C
from gleanery.streaming import events as V
from gleanery.streaming.incremental import IndexStore, incremental_index, upsert


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e"), ("d", "e")], "src string, dst string")
    got = {r.node: r.pagerank for r in G.pagerank(edges).collect()}
    assert got == pytest.approx({"a": 0.350178, "b": 0.188417, "c": 0.365397, "d": 0.039591, "e": 0.056417}, abs=2e-6)
    assert sum(got.values()) == pytest.approx(1, abs=1e-5)
    assert G.pagerank(edges.limit(0)).count() == 0
    assert rows(G.dangling(G.edges(edges))) == [("e",)]
    assert rows(G.degrees(G.edges(edges)).filter("node = 'c'")) == [("c", 3, 1)]
    assert rows(G.reachable(edges, spark.createDataFrame([("b",)], "node string"), 2)) == [("a", 2), ("b", 0), ("c", 1)]


def test_suggestions(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("spark", "spare", "sport", "shark", "zebra")], "term string")
    got = rows(S.suggestions(vocabulary, spark.createDataFrame([("sparc",), ("zebra",)], "word string"), most=3))
    assert got == [("sparc", "shark", 2), ("sparc", "spare", 1), ("sparc", "spark", 1), ("zebra", "zebra", 0)]


def test_relevance(spark):
    df = spark.createDataFrame([("spark x", "a sparkling day", "spark"), ("x", "sparks", "y"), ("x", "y", "sparkle"), ("x", "y", "z"), ("Breaking News spark", "", ""), (None, None, None)], "t string, d string, c string")
    got = [r[0] for r in df.select(S.relevance(["spark"], F.col("t"), F.col("d"), F.col("c"))).collect()]
    assert got == [pytest.approx(min(1, __import__("math").log(1 + 8 + 2.1 + 0.9) / __import__("math").log(15)), abs=1e-4), 0.4519, 0.25, 0, 0, 0]


def search_tables(spark):
    docs = spark.createDataFrame([(1, "http://a.org/1", "garden", "about gardens", 0.05, 0.9, 0.9), (2, "http://b.org/2", "garden bridge", "", None, None, None), (3, "http://a.org/3", "x", "y", 0.1, 0.1, 0.1)], "doc_id long, url string, title string, description string, pagerank double, panda_score double, penguin_score double")
    posts = spark.createDataFrame([("garden", 1), ("garden", 2), ("bridg", 2), ("x", 3)], "term string, doc_id long")
    return docs, posts


def test_search(spark):
    docs, posts = search_tables(spark)
    r = S.search(docs, posts, "the gardens", num_results=1)
    assert (r.total, r.pages, [x.doc_id for x in r.results.collect()]) == (2, 2, [1])
    assert [x.doc_id for x in S.search(docs, posts, "garden", page=2, num_results=1).results.collect()] == [2]
    assert S.search(docs, posts, "garden", domain="B.org").total == 1
    assert S.search(docs, posts, "garden bridge", mode="all").total == 1
    assert S.search(docs, posts, "gardem").suggestions == ["garden"]
    assert S.search(docs, posts, "the of").total == 0
    with pytest.raises(ValueError):
        S.search(docs, posts, " ")
    assert S.ranking_info()["strategies"]["balanced"]["pagerank"] == 0.25


def test_search_stemmed_reads_whole_texts(spark, tmp_path):
    from gleanery.plans.search import search_stemmed

    front = "Nothing of it stands here. " * 10
    data = [(1, "http://a.org/1", "One", front + "The gardens are open."), (2, "http://a.org/2", "Two", "A bridge. " + front), (3, "http://a.org/3", "Three", "A bridge. " + front + "Two bridges and a garden. " * 9), (4, "http://a.org/4", "Four", front)]
    spark.createDataFrame(data, "doc_id long, url string, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in search_stemmed(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[3].rank_score > got[2].rank_score > got[1].rank_score
    assert all(len(r.description) == 200 for r in got.values())


def test_bm25(spark):
    docs = spark.createDataFrame([(1, ["a"] * 3 + ["z"] * 147)] + [(i, ["a"] if i < 4 else ["q"]) for i in range(2, 12)], "doc_id long, words array<string>")
    got = {r.doc_id: r.bm25 for r in I.bm25(docs, ["a"]).collect()}
    idf = __import__("math").log(1 + 11 / 4)
    assert got[1] == pytest.approx(idf * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 150 / 300)))
    assert set(got) == {1, 2, 3}


def test_index(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, ["b"]), (3, []), (4, None)], "doc_id long, words array<string>")
    flat = I.postings(docs)
    assert rows(I.compact(flat)) == [("a", [1]), ("b", [1, 2])]
    assert rows(I.index_stats(flat, docs)) == [(4, 2, 1.5, 2, 1)]
    assert rows(I.index_stats(flat.limit(0), docs.limit(0))) == [(0, 0, 0.0, 0, 0)]
    assert rows(I.match_all(flat, ["a", "b"])) == [(1,)] and rows(I.match_any(flat, ["a", "b"])) == [(1,), (2,)]
    dup = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "doc_id long, fp string")
    assert rows(I.exact_duplicates(dup, "fp", [F.col("doc_id")]).select("doc_id")) == [(1,), (3,), (4,), (5,)]


def test_frontier(spark):
    c = spark.createDataFrame([("http://a.org/x", False, 2), ("http://a.org/x/", True, 0), ("http://a.org/login", False, 1), ("http://b.org/deep", False, 9), ("http://full.org/p", False, 1), ("http://full.org/s", True, 1), ("http://v.org/", False, 1), ("http://k.org/", False, 1), ("http://k.org/seed", True, 0), ("bad", False, 0)], "url string, is_seed boolean, depth int")
    visited = spark.createDataFrame([("http://v.org/",)], "url string")
    known = spark.createDataFrame([("http://k.org/",), ("http://k.org/seed",)], "url string")
    counts = spark.createDataFrame([("full.org", 200)], "domain string, pages int")
    got = rows(P.admitted(c, visited, known, counts))
    assert got == [("http://a.org/x", True, 0, 0), ("http://full.org/s", True, 1, 0), ("http://k.org/seed", True, 0, 0)]
    assert [r.url for r in P.order(P.admitted(c, visited, known, counts), 2).collect()] == ["http://a.org/x", "http://k.org/seed"]
    assert "http://full.org/s" not in {r.url for r in P.requeued(c, visited, counts).collect()}
    many = spark.createDataFrame([(f"http://h.org/{i:03}", False, 1, 1) for i in range(300)], "url string, is_seed boolean, depth int, priority int")
    kept = P.capped_by_domain(many, spark.createDataFrame([("h.org", 5)], "domain string, pages int"), 20)
    assert sorted(r.url for r in kept.collect()) == [f"http://h.org/{i:03}" for i in range(15)]
    seeds = spark.createDataFrame([("http://s.org/",)], "url string")
    links = spark.createDataFrame([("http://s.org/", "http://s.org/a"), ("http://s.org/a", "http://s.org/b"), ("http://s.org/b", "http://s.org/")], "src string, dst string")
    assert [(r.url, r.depth) for r in P.crawl(links, seeds).orderBy("depth").collect()] == [("http://s.org/", 0), ("http://s.org/a", 1), ("http://s.org/b", 2)]
    assert P.crawl(links, seeds, limit=2).count() == 2
    assert P.refilled(11, 99, seeds, seeds, visited).count() == 0 and P.refilled(3, 1, seeds, seeds, visited).count() == 0 and P.refilled(0, 0, seeds, seeds, visited).count() == 2
    assert rows(P.new_seeds(seeds, visited)) == [("http://s.org/", "added"), ("http://v.org/", "removed")]


def test_sitemaps(spark):
    fetched = spark.createDataFrame(
        [
            ("http://e.org/sitemap.xml", "application/xml", "<?xml version='1.0'?><sitemapindex xmlns='x'><sitemap><loc> http://e.org/a.xml </loc></sitemap><sitemap><loc>http://e.org/b.txt</loc></sitemap><sitemap><loc>http://e.org/sitemap.xml</loc></sitemap></sitemapindex>"),
            ("http://e.org/a.xml", None, "<urlset><url><loc>http://e.org/1?a&amp;b=1</loc></url><url><loc><![CDATA[http://e.org/2/]]></loc></url></urlset>"),
            ("http://e.org/b.txt", "text/plain", "http://e.org/3\r\n\nnot a url\n"),
            ("http://e.org/c", "text/html", "<html><a href='/4'>x</a></html>"),
            ("http://e.org/d", "image/png", "???"),
        ],
        "url string, content_type string, text string",
    )
    roots = spark.createDataFrame([("http://e.org/sitemap.xml",), ("http://e.org/c",)], "url string")
    assert {r.url for r in C.sitemap_urls(fetched, roots).collect()} == {"http://e.org/1?a=&b=1", "http://e.org/2", "http://e.org/3", "http://e.org/4"}
    kinds = {r.sitemap: r.kind for r in C.sitemap_entries(fetched).select("sitemap", "kind").distinct().collect()}
    assert kinds["http://e.org/d"] == "bad" and kinds["http://e.org/c"] == "html"
    data = spark.createDataFrame([(1, gzip.compress(b"<urlset/>")), (2, b"plain"), (3, b"\x1f\x8bbroken"), (4, None)], "i int, b binary")
    assert [r[0] for r in data.orderBy("i").select(C.gunzipped("b")).collect()] == ["<urlset/>", "plain", None, None]


def test_deep_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>http://h.org/{}.xml</loc></sitemap></sitemapindex>"
    data = [(f"http://h.org/{i}.xml", "text/xml", index.format(i + 1)) for i in range(6)] + [("http://h.org/6.xml", "text/xml", "<urlset><url><loc>http://h.org/page</loc></url></urlset>")]
    fetched = spark.createDataFrame(data, "url string, content_type string, text string")
    got = C.sitemap_urls(fetched, fetched.filter("url = 'http://h.org/0.xml'").select("url"))
    assert [r.url for r in got.collect()] == ["http://h.org/page"]


def test_sitemap_entries_do_not_carry_their_text(spark, monkeypatch):
    """The resolver's queue holds its input rows, so with the text in each a sitemap would take the square of its entries."""
    text = "<urlset>" + "".join(f"<url><loc>http://h.org/{i}</loc></url>" for i in range(50)) + "</urlset>"
    fetched = spark.createDataFrame([("http://h.org/a.xml", "text/xml", text), ("http://h.org/b", "text/html", "<html><a href='./c'>c</a></html>")], "url string, content_type string, text string")
    written = []
    monkeypatch.setattr(C, "cut", lambda df: written.append(df) or cut(df))
    got = C.sitemap_urls(fetched, fetched.select("url"))
    assert sorted(r.url for r in got.collect()) == sorted([f"http://h.org/{i}" for i in range(50)] + ["http://h.org/c"])
    plan = written[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = [part.strip().split("\n") for part in plan.split("\n\n")]
    inputs = [part[1] for part in parts if "ArrowEvalPython" in part[0]]
    assert len(inputs) == 1 and inputs[0].startswith("Input") and "text#" not in inputs[0]
    # the steps of an address stand in the plan once, with their table of references
    assert len(plan) < 1_000_000


def test_robots(spark):
    text = "User-agent: *\nDisallow: /p\nCrawl-delay: 2.5\nsitemap : http://e.org/S.xml"
    df = spark.createDataFrame([("http://e.org", text, "http://e.org/p/x"), ("http://e.org", text, "http://e.org/q"), ("http://f.org", None, "http://f.org/p")], "origin string, text string, url string")
    assert [r[0] for r in df.select(C.robots_allowed("any")(F.col("text"), F.col("url"))).collect()] == [False, True, True]
    assert df.select(C.crawl_delay(F.col("text"))).first()[0] == 2.5
    assert rows(C.robots_sitemaps(df)) == [("http://e.org", "http://e.org/S.xml")]


def test_legacy_and_snapshots(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"a": [1, 2, 2], "b": [2]}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "d.json").write_text(json.dumps({"7": {"url": "u", "title": "t"}}))
    assert rows(C.index_from_json(spark, str(tmp_path / "i.json"))) == [("a", 1), ("a", 2), ("b", 2)]
    assert C.index_from_json(spark, str(tmp_path / "bad.json")).count() == 0
    assert rows(C.documents_from_json(spark, str(tmp_path / "d.json"))) == [(7, "u", "t", None, 0.0, 0.5, 0.5)]
    one, two = spark.range(3), spark.range(5)
    assert C.write_snapshot({"t": one}, str(tmp_path / "s"), "1") and C.write_snapshot({"t": two}, str(tmp_path / "s"), "2")
    assert C.read_snapshot(spark, str(tmp_path / "s"), "t").count() == 5
    assert not C.write_snapshot({"t": two}, str(tmp_path / "s"), "3", max_total_mb=1e-9)
    assert C.read_snapshot(spark, str(tmp_path / "s"), "t").count() == 5


def pages(spark, data):
    return spark.createDataFrame([(u, f, w, i) for i, (u, f, w) in enumerate(data)], "url string, fingerprint string, words array<string>, seq long")


def test_upsert(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    upsert(store, pages(spark, [("u1", "A", ["x", "y"])]))
    assert rows(store.read("documents")) == [(0, "u1", "A", ["x", "y"])]
    upsert(store, pages(spark, [("u2", "A", ["x", "y"])]))
    assert rows(store.read("documents")) == [(0, "u2", "A", ["x", "y"])]
    upsert(store, pages(spark, [("u2", "B", ["y", "z"])]))
    assert rows(store.read("postings")) == [("y", 0), ("z", 0)]
    upsert(store, pages(spark, [("u3", "A", ["x"])]))
    assert rows(store.read("documents")) == [(0, "u3", "A", ["x"])]
    upsert(store, pages(spark, [("u4", None, None), ("u5", "C", [])]), keep_stale=False)
    assert sorted(r.url for r in store.read("documents").collect()) == ["u3", "u4", "u5"]
    before = {n: rows(store.read(n)) for n in ("documents", "fingerprints", "postings")}
    store.compact()
    assert {n: rows(store.read(n)) for n in before} == before and store.pointer()["generation"] == 1
    upsert(store, pages(spark, [("u3", "D", ["q"])]), keep_stale=False)
    assert rows(store.read("postings")) == [("q", 0)] and ("A", 0) not in rows(store.read("fingerprints"))


def test_store_survives_interruption(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), buckets=4, compact_every=2)
    upsert(store, pages(spark, [(f"u{i}", f"f{i}", ["a"]) for i in range(3)]))
    # a publication that ends before its pointer: its files are there, the state is the one before
    half = {"documents": spark.createDataFrame([(9, "x", "y", ["z"])], "doc_id long, url string, fingerprint string, words array<string>")}
    half["documents"].withColumn("b", F.lit(0)).write.parquet(str(tmp_path / "i/g0/documents/log/v=1"))
    (tmp_path / "i/pointers/.draft-x").write_text("{")
    again = IndexStore(spark, str(tmp_path / "i"), buckets=4, compact_every=2)
    assert again.read("documents").count() == 3
    # a restarted stream skips the batch that was published before the failure
    again.merge(pages(spark, [("u3", "f3", ["b"])]), number=("stream", 0))
    assert again.pointer()["batches"] == {"stream": 0} and again.pointer()["generation"] == 1 and again.pointer()["next_id"] == 4
    upsert(again, pages(spark, [("u1", "f9", ["c"]), ("u4", "f0", ["d"])]))
    assert rows(again.read("documents").select("doc_id", "url", "fingerprint")) == [(0, "u4", "f0"), (1, "u1", "f9"), (2, "u2", "f2"), (3, "u3", "f3")]
    assert sorted(r.url for r in again.read("urls").collect()) == ["u1", "u2", "u3", "u4"]
    # a batch reads only the buckets of its keys
    key = spark.createDataFrame([("u1",)], "url string")
    assert again.near("urls", key).count() < 4 and again.near("urls", key).filter("url = 'u1'").count() == 1


def test_cut_frees_copies(spark):
    import os

    one = cut(spark.range(3))
    two = cut(one.withColumn("x", F.lit(1)), replaces=None)
    assert os.path.exists(one.written_to)
    three = cut(two.withColumn("y", F.lit(1)), replaces=one)
    assert not os.path.exists(one.written_to) and three.count() == 3


def test_stream_equals_batch(spark, tmp_path):
    data = [(f"u{i}", f"f{i}", [f"w{i % 7}", "all"]) for i in range(40)]
    for k in range(4):
        pages(spark, data).filter(F.col("seq") % 4 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}.parquet"))
    stream = spark.readStream.schema("url string, fingerprint string, words array<string>, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    store = IndexStore(spark, str(tmp_path / "s"))
    incremental_index(stream, store, str(tmp_path / "c")).awaitTermination()
    batch = IndexStore(spark, str(tmp_path / "b"))
    upsert(batch, pages(spark, data))
    terms = lambda s: rows(s.read("documents").select("url", "fingerprint", "words"))
    assert terms(store) == terms(batch) and store.read("postings").count() == batch.read("postings").count()
    assert sorted(r.doc_id for r in store.read("documents").collect()) == list(range(40))


def test_stream_of_many_files_is_three_batches(spark, tmp_path, monkeypatch):
    from gleanery.plans import crawl as Q

    pages = spark.read.parquet("/root/testdata/sf0.001/content_score_input.parquet")
    pages.coalesce(1).write.parquet(f"{tmp_path}/one/content_score_input.parquet")
    pages.repartition(5).write.parquet(f"{tmp_path}/many/content_score_input.parquet")
    stores = []
    monkeypatch.setattr(Q, "IndexStore", lambda *a: stores.append(IndexStore(*a)) or stores[-1])
    got = {n: rows(Q.incremental_documents(spark, f"{tmp_path}/{n}")) for n in ("one", "many")}
    assert got["one"] == got["many"] and len(got["one"]) > 50
    assert [(s.version(), list(s.pointer()["batches"].values())) for s in stores] == [(2, [2])] * 2


def test_breaker_stream_equals_batch(spark, tmp_path):
    random.seed(1)
    start = dt.datetime(2024, 1, 1)
    data = [(f"o{random.randrange(4)}", start + dt.timedelta(seconds=i), i, random.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(data, "origin string, at timestamp, order long, bad boolean")
    df.filter("order < 150").coalesce(1).write.parquet(str(tmp_path / "in/0.parquet"))
    df.filter("order >= 150").coalesce(1).write.parquet(str(tmp_path / "in/1.parquet"))
    batch = H.breaker(df, "origin", "at", "order", F.col("bad"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = V.open_circuits(stream, F.col("bad")).writeStream.format("memory").queryName("circuits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("circuits").select("origin", "opened_at", "until", "failures")) == rows(batch.select("origin", "opened_at", "until", "failures"))


def test_windows_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at), ("a", at + dt.timedelta(minutes=5)), ("b", at + dt.timedelta(hours=2))], "type string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in/0.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
    V.windowed(stream, "at", "type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.type, r.n) for r in spark.table("windows").collect()) == sorted((r.type, r.n) for r in V.windowed(df, "at", "type").collect()) == [("a", 2), ("b", 1)]
    assert rows(V.counts(df)) == [("a", 2), ("b", 1)]


def test_health(spark):
    said = ["Initialization Sequence Completed", "AUTH_FAILED", "no route to host", None, "Connection refused by x"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, m string")
    assert [r[0] for r in df.orderBy("i").select(H.outcome(F.col("m"))).collect()] == ["success", "auth_failed", "no_route", "unknown_failure", "connection_refused"]
    assert df.select(H.score(F.lit(2), F.lit(1), F.lit("auth_failed"))).first()[0] == 240 - 20 - 280


def test_join_counted_and_running_total(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    joined = join_counted(left, right, ["k"], "n", left.count())
    assert rows(joined.select("id", "v")) == rows(left.join(right, "k").select("id", "v"))
    total = running_total(left, ["k"], [F.col("id").asc()], F.lit(1), "before")
    want, seen = {}, {}
    for i, k in sorted(tuple(r) for r in left.collect()):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert {r.id: r.before for r in total.collect()} == want
    assert running_total(left.limit(0), ["k"], [F.col("id").asc()], F.lit(1), "before").count() == 0
    assert cut(left.limit(0)).count() == 0


def test_circuits(spark, tmp_path):
    from gleanery.operators import circuit as K

    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    data = [("a", at(i), i, "connection") for i in range(4)] + [("a", at(1000), 5, "ok"), ("b", at(0), 0, "forbidden"), ("b", at(1799), 1, "ok"), ("b", at(1801), 2, "timeout")] + [("c", at(i), i, "timeout") for i in range(6)] + [("d", at(0), 0, "connection"), ("d", at(1), 1, "ok"), ("d", at(2), 2, "connection")]
    df = spark.createDataFrame(data, "origin string, at timestamp, order long, kind string")
    got = {(r.origin, r.at): (r.skipped, r.failures, r.blocked_until) for r in K.circuits(df).collect()}
    assert got[("a", at(2))] == (False, 3, at(902)) and got[("a", at(3))][0] and got[("a", at(1000))] == (False, 0, None)
    assert got[("b", at(1799))][0] and got[("b", at(1801))] == (False, 1, None)
    assert got[("c", at(4))] == (False, 5, at(604)) and got[("c", at(5))][0]
    assert got[("d", at(2))] == (False, 1, None)
    df.filter("order < 3").coalesce(1).write.parquet(str(tmp_path / "in/0.parquet"))
    df.filter("order >= 3").coalesce(1).write.parquet(str(tmp_path / "in/1.parquet"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    K.stream_circuits(stream).writeStream.format("memory").queryName("blocked").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("blocked")) == rows(K.circuits(df))


def test_pages(spark):
    from gleanery.operators import pages as A

    raw = [
        ("http://E.org:80/a?utm_source=x", "<title>A</title><link rel=canonical href='/c'><link rel='canonical' href='/c/'><a href='b'>b</a><a href='b'>b</a>", None),
        ("http://e.org/n", "<meta name='robots' content='NOINDEX'><a href='/x'>x</a>", None),
        ("http://e.org/f", "<p>t</p><a href='/y'>y</a>", "nofollow, noarchive"),
        ("http://e.org/none", "<meta name=\"robots\" content=\"noindex,nofollow\"><a href='/z'>z</a>", None),
        ("http://e.org/null", None, None),
    ]
    r = A.extracted(spark.createDataFrame(raw, "url string, html string, robots string"))
    assert sorted(x.url for x in A.indexed(r).collect()) == ["http://e.org/c", "http://e.org/f"]
    assert rows(A.links(r)) == [("http://e.org/c", "http://e.org/b")] * 2 + [("http://e.org/n", "http://e.org/x")]
    assert sorted(x.url for x in A.graph_sources(r).collect()) == ["http://e.org/c", "http://e.org/f", "http://e.org/n"]


def test_explain_and_suggest(spark):
    docs, posts = search_tables(spark)
    row = S.explain(docs, "http://a.org/1").first()
    assert row.doc_id == 1 and row.rank_score > 0 and "content: high" in row.explanation
    assert S.explain(docs, "http://nowhere/").count() == 0
    assert S.suggest(posts, "g") == [] and S.suggest(posts, "gardem") == ["garden"] and S.suggest(posts, "the") == []


def test_settings(tmp_path):
    from gleanery.config import Settings, listed

    (tmp_path / "c.ini").write_text("[Crawler]\nmax_crawl_depth = 4\nblacklist_patterns = /a,/b\nmax_pages_per_domain = many\n[Url]\ntracking_query_keys = x|y\n")
    s = Settings(str(tmp_path / "c.ini"), max_query_strings=2)
    rules = s.frontier_rules()
    assert (rules.max_depth, rules.pages_per_domain, rules.urls.blacklist, rules.urls.max_query_items, rules.urls.max_path_depth) == (4, 200, ("/a", "/b"), 2, 5)
    assert s.tracking()[1] == ("x", "y") and listed(None, ("d",)) == ("d",) and listed("a, b\nc|") == ("a", "b", "c")


def test_resume_and_publication(spark, tmp_path):
    from gleanery.operators import publish as B

    state = {"queue": ["http://E.org:80/a/", "http://e.org/b", ""], "visited_urls": ["http://e.org/v"], "known_urls": ["http://e.org/k"], "url_depth_map": {"http://e.org/a": 3}, "url_seed_map": {"http://e.org/a": True}, "pagerank_graph": {"http://e.org/a": ["http://e.org/b", "http://e.org/c"]}, "content_fingerprints": {"f": 7}, "doc_id_counter": 8}
    (tmp_path / "s.json").write_text(json.dumps(state))
    (tmp_path / "bad.json").write_text("[")
    s = B.state_from_json(spark, str(tmp_path / "s.json"))
    got = B.resumed(s["queue"], s["visited"], s["known"], s["depths"], s["flags"], spark.createDataFrame([("http://start.org",)], "url string"))
    assert rows(got["frontier"]) == [("http://e.org/a", True, 3, 0), ("http://e.org/b", False, 0, 1)]
    assert rows(got["known"]) == [("http://e.org/k",), ("http://start.org/",)] and rows(got["visited"]) == [("http://e.org/v",)]
    assert s["graph"].count() == 2 and rows(s["owners"]) == [("f", 7)] and s["counters"].first().doc_id_counter == 8
    assert B.state_from_json(spark, str(tmp_path / "bad.json"))["queue"].count() == 0
    pages = spark.range(70).select(F.col("id").alias("n"))
    assert rows(B.publications(pages, ["n"])) == [(1, 30, 30, False), (2, 30, 60, False), (3, 10, 70, True)]
    assert B.publications(pages.limit(0), ["n"]).count() == 0
    done = []
    publisher = B.Publisher(done.append)
    assert [publisher.offer(n) for n in (0, 29, 30, 31, 60)] == [False, False, True, False, True] and publisher.offer(61, final=True) and done == [30, 60, 61]
    publisher.lock.acquire()
    assert not publisher.offer(95)


def test_rescored_status_and_queues(spark):
    from gleanery.functions import links as L
    from gleanery.operators import publish as B

    graph = spark.createDataFrame([("http://a.org/", "http://b.org/"), ("http://c.org/", "http://b.org/"), ("nohost", "http://b.org/")], "src string, dst string")
    assert rows(L.graph_anchors(graph).select("domain", "anchor_text")) == [("a.org", "link from a.org"), ("c.org", "link from c.org"), ("unknown", "link from ")]
    docs = spark.createDataFrame([(1, "http://b.org/"), (2, "http://lonely.org/")], "doc_id long, url string")
    texts = spark.createDataFrame([(1, "Some words are here. " * 20, 80, "f")], "doc_id long, content_text string, word_count int, content_fingerprint string")
    got = {r.doc_id: r for r in B.rescored(docs, texts, graph, spark.createDataFrame([("f", 9)], "content_fingerprint string, doc_id long")).collect()}
    assert got[1].pagerank > 0 and got[2].pagerank == 0 and got[2].panda_score == 0.5 and got[1].penguin_score > got[2].penguin_score
    e = spark.createDataFrame([(1, "indexing", 5), (2, "stopped", None), (3, None, None)], "at int, state string, n int")
    assert rows(B.status(e, ["at"], F.lit(True), ["n"])) == [("refreshing", 5)] and rows(B.status(e.filter("at < 3"), ["at"], F.lit(False), ["n"])) == [("stopped", 5)]
    assert rows(B.accepted(e, ["at"], 2).select("at")) == [(1,), (2,)] and B.demo_events(spark, 200).filter("type = 'failed'").count() in range(5, 45)
    robots = spark.createDataFrame([("http://e.org", "Sitemap: http://e.org/z.xml\nsitemap: http://e.org/sitemap.xml\nSitemap: http://e.org/z.xml")], "origin string, text string")
    queue = [r.url for r in C.sitemap_queue(robots).orderBy("place").collect()]
    assert queue[:3] == ["http://e.org/z.xml", "http://e.org/sitemap.xml", "http://e.org/sitemap_index.xml"] and len(queue) == len(set(queue)) == len(C.SITEMAP_PATHS) + 1


def test_references_and_unquoted_links(spark):
    from gleanery.functions import html as H

    said = ["&eacute;t&eacute; &amp;lt; &lt;", "&#233;&#xE9; &nosuch;", "AT&T", "&#xD800;", "&NotEqualTilde;", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(H.unescaped(F.col("s"))).collect()] == ["été &lt; <", "éé &nosuch;", "AT&T", "�", "≂̸", None]
    page = spark.createDataFrame([("<a href=/x>1</a><A HREF = 'y&amp;z'>2</a><a href=\"#t\">3</a><a title='a' href=w class=c>4</a>",)], "m string")
    assert page.select(H.hrefs(F.col("m"))).first()[0] == ["/x", "y&z", "w"]


def test_shared_folder_off_local_masters(spark):
    from types import SimpleNamespace

    from gleanery.operators.scale import shared_folder

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://h:7077", applicationId="a"))
    with pytest.raises(ValueError):
        shared_folder(away)
