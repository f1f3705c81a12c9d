"""Queries on URLs, links and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import links as L
from gleanery.functions import url as U
from gleanery.functions.site import site_of
from gleanery.operators import graph as G
from gleanery.plans.text import _r
from gleanery.sources.tables import table

#: Rounds of the fixed PageRank.
ROUNDS = 5


def _variant(url):
    """A URL as links write it: capitals, default port, slash, tracking, unsorted query, fragment."""
    return F.concat(F.upper(U.scheme(url)), F.lit("://"), F.upper(U.netloc(url)), F.when(U.scheme(url) == "http", ":80").otherwise(":443"), U.path(url), F.lit("/?utm_source=x&b="), F.col("doc_id").cast("string"), F.lit("&a=1&REF=2&k=#top"))


def url_normalize(spark, d):
    return table(spark, d, "doc_info").select("doc_id", U.normalized(_variant(F.col("url"))).alias("url")).distinct()


def url_normalize_simple(spark, d):
    return table(spark, d, "doc_info").select("doc_id", U.normalized_simple(_variant(F.col("url"))).alias("url")).distinct()


def url_origin(spark, d):
    return table(spark, d, "backlink").select("target_url", U.origin(F.col("target_url")).alias("origin"), U.domain_or_unknown(F.col("target_url")).alias("domain")).distinct()


def url_skip(spark, d):
    return table(spark, d, "backlink").select("target_url", U.skipped(F.col("target_url")).alias("skipped")).distinct()


def url_join(spark, d):
    """Every page's link as seen from the page, with relative paths the parser resolves."""
    up = F.concat(F.lit("../"), F.regexp_extract("url", "([^/]*)$", 1))
    return table(spark, d, "doc_info").select("doc_id", U.resolved(F.col("url"), up).alias("url")).distinct()


def _links(spark, d):
    """Links between sites: of the domain that links to the site linked to."""
    b = table(spark, d, "backlink")
    nothing = F.lit(None).cast("string")
    return b.select(F.nullif(site_of(F.col("domain"), nothing), F.lit("")).alias("src"), site_of(nothing, F.col("target_url")).alias("dst"))


def graph_edges(spark, d):
    return G.edges(_links(spark, d))


def graph_nodes(spark, d):
    return G.nodes(graph_edges(spark, d))


def dangling_nodes(spark, d):
    return G.dangling(graph_edges(spark, d))


def link_degrees(spark, d):
    return G.degrees(graph_edges(spark, d))


def pagerank(spark, d):
    return G.pagerank(_links(spark, d), max_iterations=ROUNDS, fixed=True)


def pagerank_tol(spark, d):
    return G.pagerank(_links(spark, d))


def pagerank_supply(spark, d):
    """Suppliers to parts: a larger graph whose parts all dangle."""
    t = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return G.pagerank(t, max_iterations=ROUNDS, fixed=True)


def bfs_frontier(spark, d):
    """Links from the sites that none links to, to every site they lead to."""
    edges = graph_edges(spark, d)
    return G.reachable(edges, G.degrees(edges).filter("in_degree = 0").select("node"))


def backlinks(spark, d):
    """Distinct backlinks of each target, counted."""
    b = table(spark, d, "backlink").select("target_url", "domain", "anchor_text", "is_generic_anchor").distinct()
    return b.groupBy("target_url").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("domain").alias("domains"))


def anchor_analysis(spark, d):
    rows = table(spark, d, "backlink").select("anchor_text").distinct()
    return rows.select("anchor_text", *[c.alias(k) for k, c in L.anchor(F.col("anchor_text")).items()])


def domain_authority(spark, d):
    return table(spark, d, "backlink").select("domain").distinct().select("domain", L.domain_authority(F.col("domain")).alias("authority"))


def _backlinks(spark, d):
    return table(spark, d, "backlink").distinct()


def link_farm(spark, d):
    p = L.farm_profile(_backlinks(spark, d))
    return p.select("target_url", "links", "domains", *[_rounded(c) for c in ("concentration", "repetition", "generic_share", "farm_score")], "suspicious")


def _rounded(c):
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


def _inbound(spark, d):
    return table(spark, d, "link_profile").groupBy(F.col("url").alias("target_url")).agg(F.max("inbound_link_count").alias("inbound"))


def link_quality(spark, d):
    return L.link_quality(_backlinks(spark, d), _inbound(spark, d))


def link_quality_batch(spark, d):
    return L.link_quality(_backlinks(spark, d), _inbound(spark, d), generic_default=True)


NAMES = [
    url_normalize, url_normalize_simple, url_origin, url_skip, url_join, graph_edges, graph_nodes, dangling_nodes, link_degrees, pagerank, pagerank_tol, pagerank_supply, bfs_frontier, backlinks, anchor_analysis, domain_authority, link_farm, link_quality, link_quality_batch,
]

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(trim({})), ':[0-9]*$', ''), '\\.+$', ''), '^www\\.', '')"
_HOST = "regexp_extract({}, '^[^:/?#]+://([^/?#]*)', 1)"
_EDGES = f"SELECT DISTINCT src, dst FROM (SELECT nullif(nullif({_CLEAN.format('domain')}, ''), 'unknown') AS src, {_CLEAN.format(_HOST.format('target_url'))} AS dst FROM backlink) WHERE src IS NOT NULL"


def _pagerank(edges: str, rounds: int = ROUNDS) -> str:
    ctes = [
        f"e AS ({edges})", "nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "od AS (SELECT src, count(*) AS k FROM e GROUP BY src)", "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)", "r0 AS (SELECT node, 1.0::DOUBLE / n.n AS p FROM nodes, n)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(f"l{i} AS (SELECT coalesce(sum(p), 0) AS s FROM r{i - 1} WHERE node NOT IN (SELECT src FROM od))")
        ctes.append(f"m{i} AS (SELECT e.dst AS node, sum(r.p / od.k) AS v FROM e JOIN od USING (src) JOIN r{i - 1} r ON r.node = e.src GROUP BY e.dst)")
        ctes.append(f"r{i} AS (SELECT nodes.node, (1 - 0.85::DOUBLE) / n.n + 0.85::DOUBLE * l{i}.s / n.n + 0.85::DOUBLE * coalesce(m{i}.v, 0) AS p FROM nodes CROSS JOIN n CROSS JOIN l{i} LEFT JOIN m{i} ON m{i}.node = nodes.node)")
    return f"WITH {', '.join(ctes)} SELECT node, {_r('p', 6)} AS pagerank FROM r{rounds}"


_SPACE = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_GENERIC = ", ".join(f"'{a}'" for a in L.GENERIC_ANCHORS)


def _anchors(source: str) -> str:
    return f"""a1 AS (SELECT *, coalesce(anchor_text, '') AS raw FROM {source}),
        a2 AS (SELECT *, lower(regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS clean FROM a1),
        a3 AS (SELECT *, len(list_filter(regexp_split_to_array(clean, '{_SPACE}+'), lambda w: w <> '')) AS n, length(regexp_replace(raw, '\\P{{Lu}}', '', 'g')) AS caps, length(regexp_replace(raw, '[^!*]', '', 'g')) AS marks FROM a2),
        a4 AS (SELECT *, raw = '' OR clean IN ({_GENERIC}) AS g, raw <> '' AND (caps > n * 0.5 OR marks > 2) AS s,
            CASE WHEN raw = '' THEN 0.3 WHEN clean IN ({_GENERIC}) THEN 0.4 WHEN caps > n * 0.5 OR marks > 2 THEN 0.2 WHEN n > 10 THEN 0.8 WHEN n > 3 THEN 0.7 ELSE 0.6 END::DOUBLE AS w FROM a3)"""


def _authority(c: str) -> str:
    bare = f"replace(lower(coalesce({c}, '')), 'www.', '')"
    cases = " ".join(f"WHEN ends_with({bare}, '{s}') THEN {w}" for s, w in L.TOP_LEVEL)
    return f"(CASE WHEN coalesce({c}, '') = '' THEN 0.2 WHEN {bare} IN ({', '.join(repr(x) for x in L.HIGH_AUTHORITY)}) THEN 0.9 {cases} ELSE 0.4 END)::DOUBLE"


def _farm(generic: str) -> str:
    return f"""b AS (SELECT DISTINCT * FROM backlink), c AS (SELECT target_url, coalesce(domain, '') AS domain, lower(trim(coalesce(anchor_text, ''))) AS a, {generic} AS g FROM b),
        an AS (SELECT target_url, a, count(*) AS n FROM c GROUP BY ALL), mx AS (SELECT target_url, coalesce(max(n) FILTER (a <> ''), 0) AS m FROM an GROUP BY target_url),
        t AS (SELECT target_url, count(*) AS links, count(DISTINCT domain) AS domains, sum(g) AS g FROM c GROUP BY target_url),
        q AS (SELECT target_url, links, domains, CASE WHEN links < 3 THEN 0 ELSE 1 - domains / CAST(links AS DOUBLE) END AS concentration, CASE WHEN links < 3 THEN 0 ELSE m / CAST(links AS DOUBLE) END AS repetition, CASE WHEN links < 3 THEN 0 ELSE g / CAST(links AS DOUBLE) END AS generic_share FROM t JOIN mx USING (target_url)),
        f AS (SELECT *, CASE WHEN concentration > 0.7::DOUBLE THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN repetition > 0.3::DOUBLE THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN generic_share > 0.5::DOUBLE AND links > 10 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS farm_score FROM q)"""


def _link_quality(generic: str) -> str:
    return f"""WITH {_farm(generic)}, {_anchors('b')},
        pd AS (SELECT target_url, domain, count(*) AS n FROM c GROUP BY ALL), au AS (SELECT target_url, CAST(sum(CAST(round({_authority('domain')} * 1000) AS BIGINT) * n * n) AS DOUBLE) / 1000 / CAST(sum(n) AS DOUBLE) AS authority FROM pd GROUP BY target_url),
        ax AS (SELECT target_url, CAST(sum(CAST(round(w * 10) AS BIGINT)) AS DOUBLE) / 10 / count(*) AS anchor FROM a4 GROUP BY target_url), i AS (SELECT url AS target_url, max(inbound_link_count) AS inbound FROM link_profile GROUP BY url),
        p AS (SELECT target_url, CASE WHEN coalesce(inbound, 0) <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.1::DOUBLE + ln(CAST(inbound AS DOUBLE) + 1) / 6) END AS b_, coalesce(authority, 0.0::DOUBLE) AS a_, coalesce(anchor, 0.5::DOUBLE) AS n_,
            CASE WHEN coalesce(farm_score > 0.5::DOUBLE, false) THEN greatest(0.0::DOUBLE, 0.5::DOUBLE - farm_score) ELSE 1 - coalesce(farm_score, 0.0::DOUBLE) END AS f_, coalesce(farm_score > 0.5::DOUBLE, false) AS suspicious, CAST(coalesce(domains, 0) AS BIGINT) AS domains
            FROM i LEFT JOIN au USING (target_url) LEFT JOIN ax USING (target_url) LEFT JOIN f USING (target_url))
        SELECT target_url, {_r('b_')} AS backlink_score, {_r('a_')} AS authority_score, {_r('n_')} AS anchor_score, {_r('f_')} AS farm_score, {_r('0.0::DOUBLE + b_ * 0.25::DOUBLE + a_ * 0.35::DOUBLE + n_ * 0.20::DOUBLE + f_ * 0.20::DOUBLE')} AS overall, suspicious, domains FROM p"""


def oracle_sql() -> dict[str, str]:
    actions = "|".join(U.ACTION_PATHS)
    generic = "coalesce(CAST(is_generic_anchor AS INTEGER), 0)"
    path = "regexp_extract(target_url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
    return {
        "url_normalize": "SELECT DISTINCT doc_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://[^/]*')), '^(http://[^/]*):80$|^(https://[^/]*):443$', '\\1\\2') || regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1) || '?a=1&b=' || doc_id || '&k=' AS url FROM doc_info",
        "url_normalize_simple": "SELECT DISTINCT doc_id, lower(regexp_extract(url, '^[^:]+://[^/]*')) || CASE WHEN starts_with(url, 'http:') THEN ':80' ELSE ':443' END || regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1) AS url FROM doc_info",
        "url_origin": "SELECT DISTINCT target_url, CASE WHEN regexp_matches(target_url, '^https?://[^/?#]+') THEN regexp_extract(target_url, '^https?://[^/?#]+') END AS origin, coalesce(nullif(regexp_extract(target_url, '^[^:/?#]+://([^/?#]*)', 1), ''), 'unknown') AS domain FROM backlink",
        "url_skip": f"SELECT DISTINCT target_url, regexp_matches(lower({path}), '{actions}') OR len(list_filter(string_split(regexp_extract(target_url, '\\?([^#]*)', 1), '&'), lambda p: p <> '')) > 5 OR len(list_filter(string_split({path}, '/'), lambda p: p <> '')) > 5 OR regexp_matches(target_url, '{'|'.join(U.BLACKLIST)}') AS skipped FROM backlink",
        "url_join": "SELECT DISTINCT doc_id, regexp_extract(url, '^[^:]+://[^/]*') || CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1), '/'), lambda p: p <> '')) > 1 THEN regexp_replace(regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1), '/[^/]*/([^/]*)$', '/\\1') ELSE regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1) END AS url FROM doc_info",
        "graph_edges": _EDGES,
        "bfs_frontier": f"""WITH RECURSIVE e AS ({_EDGES}), r(node, depth) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 40)
            SELECT node, min(depth) AS depth FROM r GROUP BY node""",
        "graph_nodes": f"WITH e AS ({_EDGES}) SELECT src AS node FROM e UNION SELECT dst FROM e",
        "dangling_nodes": f"WITH e AS ({_EDGES}) SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e)",
        "link_degrees": f"WITH e AS ({_EDGES}) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node",
        "pagerank": _pagerank(_EDGES),
        "pagerank_supply": _pagerank("SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"),
        "backlinks": "SELECT target_url, count(*) AS links, count(DISTINCT domain) AS domains FROM (SELECT DISTINCT target_url, domain, anchor_text, is_generic_anchor FROM backlink) GROUP BY target_url",
        "anchor_analysis": f"WITH {_anchors('(SELECT DISTINCT anchor_text FROM backlink)')} SELECT anchor_text, CAST(CASE WHEN raw = '' THEN 0 ELSE n END AS INTEGER) AS text_length, g AS is_generic, s AS is_stuffed, w AS naturalness FROM a4",
        "domain_authority": f"SELECT DISTINCT domain, {_authority('domain')} AS authority FROM backlink",
        "link_farm": f"WITH {_farm(generic)} SELECT target_url, links, domains, {_r('concentration', 6)} AS concentration, {_r('repetition', 6)} AS repetition, {_r('generic_share', 6)} AS generic_share, {_r('farm_score', 6)} AS farm_score, farm_score > 0.5::DOUBLE AS suspicious FROM f",
        "link_quality": _link_quality(generic),
        "link_quality_batch": _link_quality("1"),
    }
