"""Queries on the frontier, sitemaps, health, events and the incremental index, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import url as U
from gleanery.operators import circuit as K
from gleanery.operators import frontier as P
from gleanery.operators import health as H
from gleanery.operators import pages as A
from gleanery.operators.index import postings
from gleanery.operators.scale import shared_folder
from gleanery.plans import text as X
from gleanery.plans.graph import graph_edges
from gleanery.sources import crawl as C
from gleanery.sources.tables import table
from gleanery.streaming import events as V
from gleanery.streaming.incremental import IndexStore, changed, incremental_index

CAP = 20


def _candidates(spark, d):
    """Backlink targets, at the depth of their paths; those linked to without an anchor are seeds."""
    b = table(spark, d, "backlink")
    depth = F.size(F.filter(F.split(U.path(F.col("target_url")), "/"), lambda p: p != ""))
    return b.select(F.col("target_url").alias("url"), F.col("anchor_text").isNull().alias("is_seed"), depth.alias("depth"))


def _visited(spark, d):
    return table(spark, d, "doc_info").filter("panda_score is null").select("url").distinct()


def _known(spark, d):
    return table(spark, d, "doc_info").filter("penguin_score is null").select("url").distinct()


def _counts(spark, d):
    return table(spark, d, "link_profile").select("doc_id", "url").distinct().groupBy(U.netloc(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


def frontier_admitted(spark, d):
    rules = P.FrontierRules(pages_per_domain=CAP)
    return P.admitted(_candidates(spark, d), _visited(spark, d), _known(spark, d), _counts(spark, d), rules)


def frontier_order(spark, d):
    return P.order(frontier_admitted(spark, d), 100)


def frontier_domain_cap(spark, d):
    none = _counts(spark, d).limit(0)
    open_ = P.admitted(_candidates(spark, d), _visited(spark, d), _known(spark, d), none)
    return P.capped_by_domain(open_, none, CAP)


def frontier_requeue(spark, d):
    return P.requeued(_candidates(spark, d), _visited(spark, d), _counts(spark, d), P.FrontierRules(pages_per_domain=CAP))


def frontier_refill(spark, d):
    seeds = table(spark, d, "doc_info").filter("pagerank is null").select("url").distinct()
    return P.refilled(0, 0.0, seeds, table(spark, d, "backlink").select(F.col("target_url").alias("url")), _visited(spark, d)).distinct()


def frontier_crawl(spark, d):
    edges = graph_edges(spark, d).select(F.concat(F.lit("http://"), "src", F.lit("/")).alias("src"), F.concat(F.lit("http://"), "dst", F.lit("/")).alias("dst"))
    # the crawl starts at the sites that none links to and ends when nothing waits
    seeds = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("url"))
    return P.crawl(edges, seeds)


def seed_diff(spark, d):
    return P.new_seeds(table(spark, d, "backlink").select(F.col("target_url").alias("url")), table(spark, d, "doc_info").select("url"))


def seed_reset(spark, d):
    return P.reset_seeds(table(spark, d, "doc_info").select("url").distinct(), _visited(spark, d))


def recovered_counters(spark, d):
    return P.recovered_counters(table(spark, d, "doc_info"))


def _origins(spark, d):
    return table(spark, d, "doc_info").select(U.origin(F.col("url")).alias("origin")).filter("origin is not null").distinct()


def sitemap_candidates(spark, d):
    return C.sitemap_candidates(_origins(spark, d))


def robots_sitemaps(spark, d):
    robots = _origins(spark, d).withColumn("text", F.concat(F.lit("User-agent: *\nDisallow: /private\nSITEMAP: "), "origin", F.lit("/sitemap.xml#a\nsitemap:/relative\n")))
    return C.robots_sitemaps(robots)


def robots_allowed(spark, d):
    robots = F.lit("User-agent: *\nDisallow: /a\nDisallow: /s\n")
    rows = table(spark, d, "doc_info").select("doc_id", "url").distinct()
    return rows.select("doc_id", C.robots_allowed("gleanery")(robots, F.col("url")).alias("allowed"))


def _sitemaps(spark, d):
    """One sitemap for each first path segment of a host, and an index of them for each host."""
    pages = table(spark, d, "doc_info").select("url").distinct().withColumn("base", U.origin(F.col("url"))).withColumn("part", F.regexp_extract(U.path(F.col("url")), "^/([^/]*)", 1))
    own = F.concat("base", F.lit("/"), "part", F.lit("/sitemap.xml"))
    loc = lambda c: F.concat(F.lit("<url><loc>"), c, F.lit("</loc></url>"))
    head = F.lit('<?xml version="1.0"?>')
    leaves = pages.groupBy("base", "part", own.alias("url_")).agg(F.concat(head, F.lit("<urlset>"), F.array_join(F.collect_list(loc(F.col("url"))), ""), F.lit("</urlset>")).alias("text"))
    index = leaves.groupBy("base").agg(F.concat(head, F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url_", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("text"))
    roots = index.select(F.concat("base", F.lit("/sitemap.xml")).alias("url"), "text")
    return leaves.select(F.col("url_").alias("url"), "text").unionByName(roots).withColumn("content_type", F.lit("application/xml")), roots.select("url")


def sitemap_urls(spark, d):
    fetched, roots = _sitemaps(spark, d)
    return C.sitemap_urls(fetched, roots)


def data_limits(spark, d):
    """Megabytes of the index tables as JSON, and whether they fit the limits."""
    docs = table(spark, d, "doc_info").distinct()
    flat = postings(table(spark, d, "doc_words").filter("words is not null"))
    rows = [("documents", C.payload_mb(docs)), ("postings", C.payload_mb(flat))]
    return spark.createDataFrame([(n, mb, mb <= 2048.0) for n, mb in rows], "name string, mb double, fits boolean")


def health_outcomes(spark, d):
    words = [("click", "connection timed out"), ("view", "Initialization Sequence Completed"), ("error", "TLS handshake failed"), ("signup", "AUTH_FAILED"), ("purchase", "other")]
    said = F.lit("other")
    for kind, message in words:
        said = F.when(F.col("event_type") == kind, message).otherwise(said)
    return table(spark, d, "events").select("event_id", H.outcome(said).alias("outcome"))


def health_rollup(spark, d):
    e = table(spark, d, "events").withColumn("outcome", F.when(F.col("event_type") == "error", "connection_timeout").otherwise("success"))
    return H.rollup(e, "user_id", F.col("event_type") == "error", "ts", "outcome")


def health_score(spark, d):
    r = health_rollup(spark, d)
    return r.select("user_id", H.score(F.col("success_count"), F.col("failure_count"), F.col("last_outcome")).alias("score"))


def breaker(spark, d):
    return H.breaker(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


def politeness(spark, d):
    p = H.politeness(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "user_id", "ts", "event_id", F.col("event_type") == "error", F.lit(None).cast("double"))
    return p.select("event_id", "failures", "delay")


def circuits(spark, d):
    """Users as origins, their events as outcomes of fetches."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "connection").when(F.col("event_type") == "signup", "timeout").otherwise("ok")
    return K.circuits(e.select(F.col("user_id").cast("string").alias("origin"), F.col("ts").alias("at"), F.col("event_id").alias("order"), kind.alias("kind")))


def _records(spark, d):
    pages = table(spark, d, "content_score_input").select("doc_id", "url", F.col("html_text").alias("html"), F.lit(None).cast("string").alias("robots"))
    return A.extracted(pages)


def page_records(spark, d):
    """Index records of the fetched pages, without their long fields."""
    r = A.indexed(_records(spark, d))
    return r.select("url", "title", "description", F.col("word_count").cast("long").alias("word_count"), "content_fingerprint").distinct()


def page_links(spark, d):
    return A.links(_records(spark, d)).distinct()


def page_sources(spark, d):
    return A.graph_sources(_records(spark, d))


def html_only(spark, d):
    """Responses by their content type; here those with markup claim to be HTML."""
    kind = F.when(F.col("html_text").isNotNull(), "text/HTML; charset=utf-8").otherwise("application/pdf")
    return C.html_only(table(spark, d, "content_score_input").select("doc_id", kind.alias("content_type"))).distinct()


def event_counts(spark, d):
    return V.counts(table(spark, d, "events"), "event_type")


def event_windows(spark, d):
    """Backlinks found in each day and their kind, by event time."""
    b = table(spark, d, "backlink").withColumn("kind", F.when(F.col("is_generic_anchor"), "generic").otherwise("other"))
    return V.windowed(b, "found_at", "kind", "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _batch(pages):
    return pages.filter("url is not null").select("url", F.col("content_fingerprint").alias("fingerprint"), T.tokens(F.col("content_text")).alias("words"), F.struct("crawled_at", "doc_id").alias("seq"))


def index_upsert(spark, d):
    """Documents after one batch of all pages on an empty index."""
    store = IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    after = changed(store, _batch(table(spark, d, "content_score_input")))["documents"]
    return after.select("doc_id", "url", "fingerprint", F.size(F.array_distinct("words")).cast("long").alias("terms"))


def incremental_documents(spark, d):
    """Documents after the pages arrived as a stream in three parts, in order of time."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    source = table(spark, d, "content_score_input").select("doc_id", "url", "content_text", "content_fingerprint", "crawled_at")
    at = F.coalesce(F.unix_micros("crawled_at"), F.lit(0))
    one, two = source.select(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).first().q or (0, 0)
    store = IndexStore(spark, f"{folder}/store")
    for number, part in enumerate((at <= one, (at > one) & (at <= two), at > two)):
        source.filter(part).write.parquet(f"{folder}/in/{number}")
        # what has arrived is one batch, of however many files, and the stream goes on from its checkpoint with the next part
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in/*")
        incremental_index(_batch(stream), store, f"{folder}/progress").awaitTermination()
    return store.read("documents").select("doc_id", "url", "fingerprint", F.size(F.array_distinct("words")).cast("long").alias("terms"))


NAMES = [
    frontier_admitted, frontier_order, frontier_domain_cap, frontier_requeue, frontier_refill, frontier_crawl, seed_diff, seed_reset, recovered_counters, sitemap_candidates, robots_sitemaps, robots_allowed, sitemap_urls, data_limits, health_outcomes, health_rollup, health_score, breaker, circuits, politeness, page_records, page_links, page_sources, html_only, event_counts, event_windows, index_upsert, incremental_documents,
]

_PATH = "regexp_extract({}, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_NETLOC = "regexp_extract({}, '^[^:/?#]+://([^/?#]*)', 1)"
_NORMAL = "regexp_replace(lower(regexp_extract({0}, '^[^:]+://[^/?#]*')), '^(http://[^/]*):80$|^(https://[^/]*):443$', '\\1\\2') || CASE WHEN regexp_extract({0}, '^[^:]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract({0}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') END"
_DEPTH = f"len(list_filter(string_split({_PATH.format('target_url')}, '/'), lambda p: p <> ''))"
_COUNTS = f"SELECT {_NETLOC.format('url')} AS domain, count(*) AS pages FROM (SELECT DISTINCT doc_id, url FROM link_profile) GROUP BY 1"
_VISITED = "SELECT url FROM doc_info WHERE panda_score IS NULL"
_KNOWN = "SELECT url FROM doc_info WHERE penguin_score IS NULL"


def _admitted(known: bool, cap: str) -> str:
    skip = f"regexp_matches(lower({_PATH.format('url')}), '{'|'.join(U.ACTION_PATHS)}') OR len(list_filter(string_split({_PATH.format('url')}, '/'), lambda p: p <> '')) > 5 OR regexp_matches(url, '{'|'.join(U.BLACKLIST)}')"
    keep = f"AND (url NOT IN ({_KNOWN}) OR (is_seed AND depth = 0))" if known else ""
    return f"""cand AS (SELECT {_NORMAL.format('target_url')} AS url, anchor_text IS NULL AS is_seed, {_DEPTH} AS depth FROM backlink),
        ok AS (SELECT *, CASE WHEN is_seed THEN 0 ELSE 1 END AS priority FROM cand WHERE url IS NOT NULL AND depth <= CASE WHEN is_seed THEN 20 ELSE 6 END AND NOT ({skip})),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, depth, is_seed) AS n FROM ok),
        adm AS (SELECT url, is_seed, CAST(depth AS INTEGER) AS depth, CAST(priority AS INTEGER) AS priority FROM firsts LEFT JOIN ({_COUNTS}) c ON c.domain = {_NETLOC.format('url')} WHERE n = 1 AND url NOT IN ({_VISITED}) {keep} AND ({cap}))"""


_SPLIT = "regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\f\\x{{0b}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+')"
_STEM = "regexp_replace(regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'), '(?:n[''’]t|[''’](?:s|re|ve|ll|d|m))$', '')"


def _upserted() -> str:
    """Documents of an empty index after one batch: the last record of each URL, then the last of each fingerprint."""
    stop = ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS) if "'" not in w)
    split = _SPLIT.format("coalesce(content_text, '')")
    terms = f"CAST(len(list_distinct(list_filter(list_transform({split}, lambda w: {_STEM}), lambda t: regexp_full_match(t, '\\p{{L}}+') AND t NOT IN ({stop})))) AS BIGINT)"
    return f"""WITH one AS (SELECT DISTINCT url, content_fingerprint AS fp, content_text, crawled_at, doc_id FROM content_score_input WHERE url IS NOT NULL),
        seqs AS (SELECT *, row_number() OVER (ORDER BY crawled_at NULLS FIRST, doc_id) AS seq FROM one),
        lasts AS (SELECT url, max(seq) AS seq FROM seqs GROUP BY url),
        keyed AS (SELECT s.*, coalesce(fp, 'url:' || s.url) AS k FROM seqs s JOIN lasts USING (url, seq)),
        groups AS (SELECT k, min(seq) AS first, max(seq) AS seq FROM keyed GROUP BY k)
        SELECT row_number() OVER (ORDER BY first, k) - 1 AS doc_id, url, fp AS fingerprint, {terms} AS terms FROM groups JOIN keyed USING (k, seq)"""


def oracle_sql() -> dict[str, str]:
    by_cap = f"is_seed OR coalesce(pages, 0) < {CAP}"
    flagged = "f AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), r AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)"
    return {
        "frontier_admitted": f"WITH {_admitted(True, by_cap)} SELECT * FROM adm",
        "frontier_order": f"WITH {_admitted(True, by_cap)} SELECT * FROM adm ORDER BY priority, depth, url LIMIT 100",
        "frontier_domain_cap": f"WITH {_admitted(True, 'true')}, o AS (SELECT *, row_number() OVER (PARTITION BY {_NETLOC.format('url')} ORDER BY priority, depth, url) AS k FROM adm) SELECT url, is_seed, depth, priority FROM o WHERE k <= {CAP}",
        "frontier_requeue": f"WITH {_admitted(False, f'coalesce(pages, 0) < {CAP}')} SELECT * FROM adm",
        "frontier_refill": f"""WITH seeds AS (SELECT DISTINCT url FROM doc_info WHERE pagerank IS NULL AND url NOT IN ({_VISITED})), src AS (SELECT DISTINCT target_url AS url FROM backlink ORDER BY 1 LIMIT 200), l AS (SELECT url FROM src WHERE url NOT IN ({_VISITED}) ORDER BY url LIMIT 100)
            SELECT url, true AS is_seed, 0 AS depth FROM seeds UNION SELECT url, false, 1 FROM l""",
        "seed_diff": "SELECT DISTINCT target_url AS url, 'added' AS change FROM backlink WHERE target_url NOT IN (SELECT url FROM doc_info) UNION ALL SELECT DISTINCT url, 'removed' FROM doc_info WHERE url NOT IN (SELECT target_url FROM backlink)",
        "seed_reset": f"SELECT DISTINCT url FROM doc_info WHERE url NOT IN ({_VISITED})",
        "recovered_counters": "SELECT count(DISTINCT doc_id) AS docs_indexed, count(DISTINCT doc_id) AS crawl_count, count(DISTINCT doc_id) AS last_saved_count, max(doc_id) + 1 AS next_doc_id FROM doc_info",
        "sitemap_candidates": f"WITH o AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+') AS origin FROM doc_info) SELECT origin, origin || unnest([{', '.join(repr(p) for p in C.SITEMAP_PATHS)}]) AS url FROM o",
        "robots_sitemaps": "SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+') AS origin, regexp_replace(regexp_extract(url, '^https?://[^/?#]+'), '^(http://[^/]*):80$|^(https://[^/]*):443$', '\\1\\2') || '/sitemap.xml' AS url FROM doc_info",
        "robots_allowed": f"SELECT DISTINCT doc_id, NOT (starts_with({_PATH.format('url')}, '/a') OR starts_with({_PATH.format('url')}, '/s')) AS allowed FROM doc_info",
        "sitemap_urls": f"SELECT DISTINCT {_NORMAL.format('url')} AS url, regexp_replace(lower(regexp_extract(url, '^[^:]+://[^/?#]*')), ':(80|443)$', '') || '/' || regexp_extract(url, '^[^:]+://[^/]*/([^/]*)', 1) || '/sitemap.xml' AS sitemap FROM doc_info",
        "health_outcomes": "SELECT event_id, CASE event_type WHEN 'click' THEN 'connection_timeout' WHEN 'view' THEN 'success' WHEN 'error' THEN 'tls_error' WHEN 'signup' THEN 'auth_failed' ELSE 'unknown_failure' END AS outcome FROM events",
        "health_rollup": "SELECT user_id, count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS failure_count, CASE WHEN arg_max(event_type, (ts, CASE WHEN event_type = 'error' THEN 'connection_timeout' ELSE 'success' END)) = 'error' THEN 'connection_timeout' ELSE 'success' END AS last_outcome, max(ts) AS last_checked_at FROM events GROUP BY user_id",
        "health_score": "SELECT user_id, CAST(count(*) FILTER (event_type <> 'error') * 120 - count(*) FILTER (event_type = 'error') * 20 + CASE WHEN arg_max(event_type, (ts, CASE WHEN event_type = 'error' THEN 'connection_timeout' ELSE 'success' END)) = 'error' THEN -220 ELSE 400 END AS BIGINT) AS score FROM events GROUP BY user_id",
        "breaker": f"WITH {flagged}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r WHERE f = 1) SELECT user_id, ts AS opened_at, ts + INTERVAL 900 SECOND AS until, k AS failures FROM k WHERE k % 3 = 0",
        "politeness": f"WITH {flagged}, s AS (SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS failures FROM r) SELECT event_id, failures, CASE WHEN failures > 0 THEN least(30.0, 1.5 + 2.0 * failures) ELSE 1.5 END::DOUBLE AS delay FROM s",
        "page_records": f"WITH t AS (SELECT DISTINCT doc_id, {_NORMAL.format('url')} AS url, title, {X._TEXT} AS t, html_text FROM {X._HTML}), m AS (SELECT *, {X._stripped(X._unescaped(X._META))} AS m, {X._stripped(X._unescaped(X._TITLE))} AS tt FROM t) SELECT DISTINCT url, CASE WHEN regexp_matches(html_text, '(?is)<title[^>]*>.*?</title\\s*>') THEN tt ELSE 'No Title' END AS title, CASE WHEN m <> '' THEN m WHEN length(t) > 200 THEN t[1:200] || '...' ELSE t END AS description, CAST(len({X._words('t')}) AS BIGINT) AS word_count, sha1(t) AS content_fingerprint FROM m",
        "index_upsert": _upserted(),
        "page_links": f"""WITH h AS (SELECT url, regexp_extract(url, '^[^:]+://[^/]+') AS origin, unnest(regexp_extract_all({X._SEEN}, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM {X._HTML} WHERE NOT regexp_matches(html_text, '(?is)<meta[^>]*name=[\"'']robots[\"''][^>]*nofollow')),
            j AS (SELECT url, lower(origin) AS origin, trim({X._unescaped('href')}) AS href FROM h)
            SELECT DISTINCT {_NORMAL.format('url')} AS src, regexp_replace(origin, '^(http://[^/]*):80$|^(https://[^/]*):443$', '\\1\\2') || CASE WHEN href = '/' THEN '/' ELSE regexp_replace(href, '/+$', '') END AS dst FROM j WHERE href <> '' AND NOT starts_with(href, '#')""",
        "page_sources": f"SELECT DISTINCT {_NORMAL.format('url')} AS url FROM content_score_input WHERE html_text IS NOT NULL",
        "html_only": "SELECT DISTINCT doc_id, 'text/HTML; charset=utf-8' AS content_type FROM content_score_input WHERE html_text IS NOT NULL",
        "event_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "event_windows": "SELECT CAST(date_trunc('day', found_at) AS TIMESTAMP) AS window_start, CASE WHEN is_generic_anchor THEN 'generic' ELSE 'other' END AS kind, count(*) AS n FROM backlink WHERE found_at IS NOT NULL GROUP BY ALL",
    }
