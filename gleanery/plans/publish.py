"""Queries on resuming, publication, status, and the other forms of sitemaps and indexes, and their SQL."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.functions import links as L
from gleanery.functions import url as U
from gleanery.operators import publish as B
from gleanery.operators.index import postings
from gleanery.operators.scale import place, shared_folder
from gleanery.plans import crawl as K
from gleanery.plans import graph as G
from gleanery.plans import text as X
from gleanery.sources import crawl as C
from gleanery.sources.tables import table


def _resumed(spark, d):
    """A saved state: backlink targets wait, pages are visited or known as in the frontier queries, depths follow paths."""
    b = table(spark, d, "backlink").select(F.col("target_url").alias("url"))
    info = table(spark, d, "doc_info")
    depth = F.size(F.filter(F.split(U.path(F.col("url")), "/"), lambda p: p != ""))
    return B.resumed(b, K._visited(spark, d), K._known(spark, d), info.select("url", depth.alias("depth")), info.select("url", F.col("pagerank").isNull().alias("is_seed")), info.filter("pagerank is null").select("url"))


def resume_frontier(spark, d):
    return _resumed(spark, d)["frontier"]


def resume_visited(spark, d):
    return _resumed(spark, d)["visited"]


def resume_known(spark, d):
    return _resumed(spark, d)["known"]


def publications(spark, d):
    """Publications of a crawl that fetched the pages in order of time and identifier."""
    pages = table(spark, d, "content_score_input").select("doc_id", F.coalesce("crawled_at", F.lit("1970-01-01").cast("timestamp")).alias("at")).distinct()
    return B.publications(pages, ["at", "doc_id"])


def _page_graph(spark, d):
    """Links of the front pages of linking domains to pages."""
    b = table(spark, d, "backlink").filter("domain is not null")
    return b.select(F.concat(F.lit("http://"), "domain", F.lit("/")).alias("src"), F.col("target_url").alias("dst")).distinct()


def graph_anchors(spark, d):
    return L.graph_anchors(_page_graph(spark, d), generic=True)


def publish_scores(spark, d):
    docs = table(spark, d, "doc_info").select("doc_id", "url")
    pages = table(spark, d, "content_score_input")
    return B.rescored(docs, pages, _page_graph(spark, d), table(spark, d, "content_fingerprints"), rounds=G.ROUNDS)


def crawl_status(spark, d):
    """The status after all events, with views and clicks in place of a crawler's reports."""
    e = table(spark, d, "events")
    said = e.select("ts", "event_id", F.when(F.col("event_type") == "view", "indexing").when(F.col("event_type") == "click", "stopped").otherwise("starting").alias("state"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("crawl_count"), F.when(F.col("event_type") == "click", F.col("user_id")).alias("queue_size"))
    return B.status(said, ["ts", "event_id"], F.lit(True), ["crawl_count", "queue_size"])


def status_states(spark, d):
    e = table(spark, d, "events")
    asked = F.when(F.col("event_type") == "view", "indexing").when(F.col("event_type") == "click", "stopped").when(F.col("event_type") == "error", "error")
    return e.select("event_id", B.effective_state(asked, F.col("event_id") % 2 == 0).alias("state"))


def event_queue(spark, d):
    return B.accepted(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id")


def demo_events(spark, d):
    """An invented crawl of as many pages as there are documents."""
    return B.demo_events(spark, table(spark, d, "documents").count())


def sitemap_queue(spark, d):
    said = F.concat(F.lit("Sitemap: "), "origin", F.lit("/sitemap.txt\nDisallow: /x\nsitemap: "), "origin", F.lit("/own.xml\nSitemap: "), "origin", F.lit("/own.xml"))
    return C.sitemap_queue(K._origins(spark, d).withColumn("text", said))


def sitemap_kinds(spark, d):
    """Entries of text and HTML sitemaps, one of each kind for each host."""
    pages = table(spark, d, "doc_info").select("url").distinct().withColumn("base", U.origin(F.col("url")))
    link = F.concat(F.lit('<a href="'), "url", F.lit('">x</a>'))
    both = pages.groupBy("base").agg(F.array_join(F.collect_list("url"), "\n").alias("_t"), F.array_join(F.collect_list(link), "").alias("_h"))
    plain = both.select(F.concat("base", F.lit("/sitemap.txt")).alias("url"), F.lit("text/plain").alias("content_type"), F.col("_t").alias("text"))
    linked = both.select(F.concat("base", F.lit("/site-map")).alias("url"), F.lit("text/html").alias("content_type"), F.concat(F.lit("<html><body>"), "_h", F.lit("</body></html>")).alias("text"))
    return C.sitemap_entries(plain.unionByName(linked)).select("sitemap", "kind", "url").distinct()


def sitemap_gzip(spark, d):
    """Payloads read back from gzip."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if u is None else gzip.compress(u.encode()) for u in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    rows = table(spark, d, "doc_info").select("doc_id", "url").distinct().mapInArrow(packed, "doc_id long, data binary")
    return rows.select("doc_id", C.gunzipped("data").alias("url"))


def _written(spark, text):
    """The path of a JSON file of one row's text; the legacy format is one object in one file."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    text.write.text(path)
    system, where = place(spark, path)
    system.deleteOnExit(where)
    return path


def json_index(spark, d):
    """The inverted index written in the legacy format and loaded."""
    flat = postings(table(spark, d, "doc_words").select("doc_id", "words").filter("words is not null"))
    lists = flat.groupBy("term").agg(F.collect_list("doc_id").alias("ids"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("term", "ids")))).alias("value"))
    return C.index_from_json(spark, _written(spark, whole.coalesce(1)))


def json_documents(spark, d):
    """The document records written in the legacy format and loaded, missing scores filled in."""
    info = table(spark, d, "doc_info").distinct()
    record = F.struct("url", "title", "description", "pagerank", "panda_score", "penguin_score")
    whole = info.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), record)))).alias("value"))
    return C.documents_from_json(spark, _written(spark, whole.coalesce(1)))


NAMES = [
    resume_frontier, resume_visited, resume_known, publications, graph_anchors, publish_scores, crawl_status, status_states, event_queue, demo_events, sitemap_queue, sitemap_kinds, sitemap_gzip, json_index, json_documents,
]


def _chance(what: str) -> str:
    return f"('0x' || substr(md5('0-{what}-' || id), 1, 8))::BIGINT"


def _scores() -> str:
    graph = "SELECT DISTINCT 'http://' || domain || '/' AS src, target_url AS dst FROM backlink WHERE domain IS NOT NULL"
    quality = X._quality("o.owner IS NOT NULL").replace("content_score_input", "plain_pages")
    links = G._link_quality("0").replace("FROM backlink", "FROM graph_links").replace("FROM link_profile", "FROM graph_inbound")
    return f"""WITH graph AS ({graph}),
        plain_pages AS (SELECT doc_id, content_text, word_count, content_fingerprint, NULL::VARCHAR AS html_text, NULL::VARCHAR[] AS keywords, NULL::INTEGER AS days_old FROM content_score_input),
        graph_links AS (SELECT dst AS target_url, coalesce(nullif(regexp_extract(src, '^[^:/?#]+://([^/?#]*)', 1), ''), 'unknown') AS domain, 'link from ' || regexp_extract(src, '^[^:/?#]+://([^/?#]*)', 1) AS anchor_text, false AS is_generic_anchor FROM graph),
        graph_inbound AS (SELECT i.url, n AS inbound_link_count FROM (SELECT DISTINCT url FROM doc_info) i LEFT JOIN (SELECT dst AS url, count(*) AS n FROM graph GROUP BY dst) g USING (url)),
        pr AS ({G._pagerank(graph)}), panda AS ({quality}), penguin AS ({links})
        SELECT DISTINCT i.doc_id, i.url, coalesce(pr.pagerank, 0.0::DOUBLE) AS pagerank, coalesce(panda.overall, 0.5::DOUBLE) AS panda_score, coalesce(penguin.overall, 0.5::DOUBLE) AS penguin_score
        FROM doc_info i LEFT JOIN pr ON pr.node = i.url LEFT JOIN panda USING (doc_id) LEFT JOIN penguin ON penguin.target_url = i.url"""


def oracle_sql() -> dict[str, str]:
    normal, depth = K._NORMAL.format("url"), f"len(list_filter(string_split({K._PATH.format('url')}, '/'), lambda p: p <> ''))"
    origin = "regexp_extract(url, '^https?://[^/?#]+')"
    simple = f"regexp_replace({origin}, '^(http://[^/]*):80$|^(https://[^/]*):443$', '\\1\\2')"
    places = ", ".join(f"({i + 2}, '{p}')" for i, p in enumerate(p for p in C.SITEMAP_PATHS if p != "/sitemap.txt"))
    reasons = ", ".join(f"'{r}'" for r in B.REASONS)
    return {
        "resume_frontier": f"""WITH q AS (SELECT DISTINCT {K._NORMAL.format('target_url')} AS url FROM backlink), s AS (SELECT {normal} AS url, min({depth}) AS depth, bool_or(pagerank IS NULL) AS seed FROM doc_info GROUP BY 1)
            SELECT q.url, coalesce(seed, false) AS is_seed, CAST(coalesce(depth, 0) AS INTEGER) AS depth, CASE WHEN coalesce(seed, false) THEN 0 ELSE 1 END AS priority FROM q LEFT JOIN s USING (url) WHERE q.url IS NOT NULL""",
        "resume_visited": f"SELECT DISTINCT {normal} AS url FROM doc_info WHERE panda_score IS NULL",
        "resume_known": f"SELECT DISTINCT {normal} AS url FROM doc_info WHERE penguin_score IS NULL OR pagerank IS NULL",
        "publications": f"""WITH p AS (SELECT DISTINCT doc_id, coalesce(crawled_at, TIMESTAMP '1970-01-01') AS crawled FROM content_score_input), n AS (SELECT row_number() OVER (ORDER BY crawled, doc_id) - 1 AS n FROM p)
            SELECT n // {B.EVERY} + 1 AS version, count(*) AS pages, max(n) + 1 AS last, count(*) < {B.EVERY} AS final FROM n GROUP BY 1""",
        "graph_anchors": "SELECT DISTINCT target_url, coalesce(nullif(regexp_extract('http://' || domain || '/', '^[^:/?#]+://([^/?#]*)', 1), ''), 'unknown') AS domain, 'link from ' || regexp_extract('http://' || domain || '/', '^[^:/?#]+://([^/?#]*)', 1) AS anchor_text, true AS is_generic_anchor FROM (SELECT DISTINCT domain, target_url FROM backlink WHERE domain IS NOT NULL)",
        "publish_scores": _scores(),
        "crawl_status": """SELECT arg_max(CASE event_type WHEN 'view' THEN 'refreshing' WHEN 'click' THEN 'ready' ELSE 'starting' END, (ts, event_id)) AS status,
            arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view') AS crawl_count, arg_max(user_id, (ts, event_id)) FILTER (event_type = 'click') AS queue_size FROM events""",
        "status_states": """SELECT event_id, CASE WHEN event_type = 'view' OR event_type NOT IN ('click', 'error') THEN CASE WHEN event_id % 2 = 0 THEN 'refreshing' ELSE 'indexing' END
            WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'ready' ELSE 'stopped' END ELSE 'error' END AS state FROM events""",
        "event_queue": f"SELECT event_id FROM events ORDER BY ts, event_id LIMIT {B.WAITING}",
        "demo_events": f"""WITH n AS (SELECT unnest(range((SELECT count(*) FROM documents))) AS id), c AS (SELECT id, {_chance('fate')} % 10 < 9 AS ok FROM n)
            SELECT id, CASE WHEN ok THEN 'crawled' ELSE 'failed' END AS type, 'https://site' || {_chance('site')} % 20 || '.example/page/' || id AS url, CAST({_chance('depth')} % 4 AS INTEGER) AS depth,
            CASE WHEN ok THEN CAST({_chance('links')} % 16 + 5 AS INTEGER) ELSE 0 END AS links_found, CASE WHEN NOT ok THEN [{reasons}][{_chance('reason')} % {len(B.REASONS)} + 1] END AS reason FROM c""",
        "sitemap_queue": f"""WITH o AS (SELECT DISTINCT {origin} AS origin, {simple} AS simple FROM doc_info), u AS (SELECT * FROM (VALUES (0, '/sitemap.txt'), (1, '/own.xml'), {places}) t(place, p))
            SELECT origin, simple || p AS url, CAST(place AS INTEGER) AS place FROM o, u""",
        "sitemap_kinds": f"SELECT DISTINCT {origin} || '/sitemap.txt' AS sitemap, 'text' AS kind, {normal} AS url FROM doc_info UNION SELECT DISTINCT {origin} || '/site-map', 'html', {normal} FROM doc_info",
        "sitemap_gzip": "SELECT DISTINCT doc_id, url FROM doc_info",
        "json_index": "SELECT DISTINCT term, doc_id FROM (SELECT unnest(words) AS term, doc_id FROM doc_words) WHERE term IS NOT NULL",
        "json_documents": "SELECT DISTINCT doc_id, url, title, description, coalesce(pagerank, 0.0::DOUBLE) AS pagerank, coalesce(panda_score, 0.5::DOUBLE) AS panda_score, coalesce(penguin_score, 0.5::DOUBLE) AS penguin_score FROM doc_info",
    }
