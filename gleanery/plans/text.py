"""Queries on texts, markup and quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import quality as Q
from gleanery.functions import text as T
from gleanery.functions import url as U
from gleanery.functions.numbers import rounded
from gleanery.operators.index import exact_duplicates
from gleanery.sources.tables import table

SPACE = Q.SPACE


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_score_input")


def _once(df: DataFrame) -> DataFrame:
    """Repeated rows of a page are exact copies; what is left of them here is narrow."""
    return df.dropDuplicates(["doc_id"])


def text_length_score(spark, d):
    n = F.coalesce(F.nullif(F.col("word_count"), F.lit(0)), F.size(Q.words(F.coalesce("content_text", F.lit("")))))
    return _once(_pages(spark, d).select("doc_id", n.cast("long").alias("words"), rounded(Q.length_score(n)).alias("score")))


def text_structure(spark, d):
    counts = Q.element_counts(F.col("html_text"))
    return _once(_pages(spark, d).select("doc_id", *[c.alias(k) for k, c in counts.items()], rounded(Q.structure_score(counts)).alias("score")))


def text_readability(spark, d):
    rows = _pages(spark, d).select("doc_id", "content_text", Q.words(F.col("content_text")).alias("ws"))
    return _once(rows.select("doc_id", rounded(Q.readability(F.col("content_text"), F.col("ws"))).alias("score")))


def text_freshness(spark, d):
    return _once(_pages(spark, d).select("doc_id", rounded(Q.freshness(F.col("days_old"))).alias("score")))


def text_stuffing(spark, d):
    x = Q.density(F.col("content_text"), F.col("keywords"))
    return _once(_pages(spark, d).select("doc_id", x.alias("x"))).select("doc_id", *[rounded(F.col(f"x.{c}"), 6).alias(c) for c in ("global_density", "max_density", "stuffing")])


def content_quality(spark, d):
    return Q.content_quality(_pages(spark, d), table(spark, d, "content_fingerprints"))


def content_quality_snapshot(spark, d):
    return Q.content_quality(_pages(spark, d), table(spark, d, "content_fingerprints"), snapshot_compat=True)


def html_title(spark, d):
    return _once(_pages(spark, d).filter("html_text is not null").select("doc_id", H.title(F.col("html_text")).alias("title")))


def html_text(spark, d):
    rows = _pages(spark, d).filter("html_text is not null").select("doc_id", H.text(F.col("html_text")).alias("text"))
    text = F.col("text")
    return _once(rows.select("doc_id", F.sha1(text).alias("fingerprint"), H.word_count(text).cast("long").alias("word_count"), F.length(H.content(text)).cast("long").alias("content_length")))


def html_text_dom(spark, d):
    return _once(_pages(spark, d).filter("html_text is not null").select("doc_id", H.dom_text(F.col("html_text")).alias("text")))


def html_description(spark, d):
    rows = _pages(spark, d).filter("html_text is not null").select("doc_id", "html_text", H.text(F.col("html_text")).alias("text"))
    return _once(rows.select("doc_id", H.description(F.col("html_text"), F.col("text")).alias("description")))


def html_links(spark, d):
    base = F.coalesce(F.nullif(H.canonical(F.col("html_text")), F.lit("")), F.col("url"))
    rows = _pages(spark, d).filter("html_text is not null").select("doc_id", base.alias("base"), F.explode(H.hrefs(F.col("html_text"))).alias("href"))
    return rows.select("doc_id", U.present(U.normalized(U.resolved(F.col("base"), F.col("href")))).alias("url")).distinct()


def html_directives(spark, d):
    found = H.directives(F.col("html_text"), F.lit(None).cast("string"))
    return _once(_pages(spark, d).filter("html_text is not null").select("doc_id", F.array_contains(found, "noindex").alias("noindex"), F.array_contains(found, "nofollow").alias("nofollow")))


def text_tokens(spark, d):
    return _once(_pages(spark, d).filter("content_text is not null").select("doc_id", F.size(T.tokens(F.col("content_text"), stop=False)).cast("long").alias("tokens")))


def text_stems(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return T.with_stems(counts).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def dedup_exact(spark, d):
    """The first page of each text; pages without a text all stay."""
    narrow = _once(_pages(spark, d).select("doc_id", "url", "content_fingerprint"))
    return exact_duplicates(narrow, "content_fingerprint", [F.col("doc_id")]).select("doc_id", "url")


def dedup_documents(spark, d):
    narrow = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("fp"))
    return exact_duplicates(narrow, "fp", [F.col("doc_id")]).select("doc_id")


NAMES = [
    text_length_score, text_structure, text_readability, text_freshness, text_stuffing, content_quality, content_quality_snapshot, html_title, html_text, html_text_dom, html_description, html_links, html_directives, text_tokens, text_stems, dedup_exact, dedup_documents,
]


def _r(x: str, places: int = 4) -> str:
    return f"(floor(({x}) * {float(10**places)}::DOUBLE + 0.5) / {float(10**places)}::DOUBLE)"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


_ONE = "SELECT DISTINCT ON (doc_id) * FROM content_score_input"
_COUNTS = {k: f"CAST(len(regexp_extract_all(coalesce(html_text, ''), '{p}')) AS INTEGER)" for k, p in Q.ELEMENTS.items()}


def _length(n: str) -> str:
    n = f"CAST({n} AS DOUBLE)"
    return (
        f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {n} < 100 THEN {n} / 150 * 0.2::DOUBLE WHEN {n} < 300 THEN 0.2::DOUBLE + ({n} - 100) / 200 * 0.35::DOUBLE WHEN {n} < 800 THEN 0.55::DOUBLE + ({n} - 300) / 500 * 0.25::DOUBLE "
        f"WHEN {n} < 2000 THEN 0.8::DOUBLE + ({n} - 800) / 1200 * 0.15::DOUBLE ELSE 0.95::DOUBLE + least({n} - 2000, 3000.0::DOUBLE) / 3000 * 0.05::DOUBLE END))"
    )


_N = f"coalesce(nullif(word_count, 0), len({_words('coalesce(content_text, {q}{q})')}))".replace("{q}", "'")
_STRUCT = "least(h1 * 0.2::DOUBLE + h2 * 0.15::DOUBLE + h3 * 0.1::DOUBLE + least(paragraphs / 5.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + least(lists / 3.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + least(blockquotes / 2.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE, 1.0::DOUBLE)"
_READ = f"""CASE WHEN content_text IS NULL OR length(content_text) < 50 OR len({_words('content_text')}) = 0 OR len(list_filter(regexp_split_to_array(content_text, '[.!?]+'), lambda s: NOT regexp_full_match(s, '{SPACE}*'))) = 0 THEN 0.0::DOUBLE ELSE coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    0.6::DOUBLE * (1 - abs(len({_words('content_text')}) / CAST(nullif(len(list_filter(regexp_split_to_array(content_text, '[.!?]+'), lambda s: NOT regexp_full_match(s, '{SPACE}*'))), 0) AS DOUBLE) - 17.5::DOUBLE) / 30)
    + 0.4::DOUBLE * (1 - abs(length(array_to_string({_words('content_text')}, '')) / CAST(nullif(len({_words('content_text')}), 0) AS DOUBLE) - 5) / 10))), 0.0::DOUBLE) END"""
_FRESH = "CASE WHEN days_old IS NULL OR days_old < 0 THEN 1.0::DOUBLE ELSE greatest(0.7::DOUBLE, 1 - least(days_old, 365) / 365.0::DOUBLE * 0.3::DOUBLE) END"
_HITS = f"""hits AS (SELECT doc_id, content_text, keywords, list_transform({_words('lower(content_text)')}, lambda w: CASE WHEN list_contains(list_transform(keywords, lambda k: lower(k)), w) THEN 1 ELSE 0 END) AS h FROM one),
    usable AS (SELECT doc_id, h, len(h) AS n FROM hits WHERE coalesce(content_text, '') <> '' AND len(keywords) > 0 AND len(h) > 0),
    dens AS (SELECT doc_id, CAST(list_sum(h) AS DOUBLE) / n AS g, list_max(list_transform(range(0, n, 50), lambda i: CAST(list_sum(h[i + 1 : i + 100]) AS DOUBLE) / least(100, n - i))) AS m FROM usable),
    density AS (SELECT one.doc_id, coalesce(g, 0.0::DOUBLE) AS g, coalesce(m, 0.0::DOUBLE) AS m, least(1.0::DOUBLE, coalesce(CASE WHEN g > 0 THEN m / (g + 0.001::DOUBLE) ELSE 0.0::DOUBLE END, 0.0::DOUBLE) / 5.0::DOUBLE) AS s FROM one LEFT JOIN dens USING (doc_id))"""


def _quality(copied: str) -> str:
    return f"""
    WITH one AS ({_ONE}), {_HITS},
    counts AS (SELECT *, {", ".join(f"{c} AS {k}" for k, c in _COUNTS.items())} FROM one),
    parts AS (SELECT doc_id, coalesce(content_text, '') = '' AS e, {_length(_N)} AS l, {_STRUCT} AS st, {_READ} AS rd, CASE WHEN len(coalesce(keywords, [])) > 0 THEN 1 - density.s ELSE 1.0::DOUBLE END AS kw, CASE WHEN {copied} THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS og, {_FRESH} AS fr
        FROM counts JOIN density USING (doc_id) LEFT JOIN (SELECT content_fingerprint AS cf, doc_id AS owner FROM content_fingerprints) o ON o.cf = counts.content_fingerprint),
    filled AS (SELECT doc_id, e, CASE WHEN e THEN 0.0::DOUBLE ELSE l END AS l, CASE WHEN e THEN 0.0::DOUBLE ELSE st END AS st, CASE WHEN e THEN 0.0::DOUBLE ELSE rd END AS rd, CASE WHEN e THEN 1.0::DOUBLE ELSE kw END AS kw, CASE WHEN e THEN 1.0::DOUBLE ELSE og END AS og, CASE WHEN e THEN 1.0::DOUBLE ELSE fr END AS fr FROM parts)
    SELECT doc_id, {_r('l')} AS length_score, {_r('st')} AS structure_score, {_r('rd')} AS readability_score, {_r('kw')} AS keywords_score, {_r('og')} AS originality_score, {_r('fr')} AS freshness_score,
        {_r("CASE WHEN e THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + l * 0.30::DOUBLE + st * 0.20::DOUBLE + rd * 0.15::DOUBLE + kw * 0.15::DOUBLE + og * 0.15::DOUBLE + fr * 0.05::DOUBLE END")} AS overall FROM filled"""


# The references that the tables hold; the ampersand comes last.
_REFERENCES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))


def _unescaped(x: str) -> str:
    for name, char in _REFERENCES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_SEEN = "regexp_replace(regexp_replace(regexp_replace(html_text, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g')"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_TEXT = f"array_to_string(list_filter(list_transform(string_split(regexp_replace({_SEEN}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda n: {_stripped(_unescaped('n'))}), lambda n: n <> ''), ' ')"
_HTML = "(SELECT DISTINCT ON (doc_id) * FROM content_score_input WHERE html_text IS NOT NULL)"
_TITLE = "regexp_extract(html_text, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"
_META = "regexp_extract(html_text, '(?is)<meta\\s+name=[\"'']description[\"'']\\s+content=\"([^\"]*)\"', 1)"


def oracle_sql() -> dict[str, str]:
    return {
        "text_length_score": f"SELECT doc_id, CAST({_N} AS BIGINT) AS words, {_r(_length(_N))} AS score FROM ({_ONE})",
        "text_structure": f"WITH c AS (SELECT doc_id, {', '.join(f'{c} AS {k}' for k, c in _COUNTS.items())} FROM ({_ONE})) SELECT *, {_r(_STRUCT)} AS score FROM c",
        "text_readability": f"SELECT doc_id, {_r(_READ)} AS score FROM ({_ONE})",
        "text_freshness": f"SELECT doc_id, {_r(_FRESH)} AS score FROM ({_ONE})",
        "text_stuffing": f"WITH one AS ({_ONE}), {_HITS} SELECT doc_id, {_r('g', 6)} AS global_density, {_r('m', 6)} AS max_density, {_r('s', 6)} AS stuffing FROM density",
        "content_quality": _quality("o.owner IS NOT NULL AND o.owner <> counts.doc_id"),
        "content_quality_snapshot": _quality("o.owner IS NOT NULL"),
        "html_title": f"SELECT doc_id, CASE WHEN regexp_matches(html_text, '(?is)<title[^>]*>.*?</title\\s*>') THEN {_stripped(_unescaped(_TITLE))} ELSE 'No Title' END AS title FROM {_HTML}",
        "html_text": f"WITH t AS (SELECT doc_id, {_TEXT} AS t FROM {_HTML}) SELECT doc_id, sha1(t) AS fingerprint, CAST(len({_words('t')}) AS BIGINT) AS word_count, CAST(least(length(t), 100000) AS BIGINT) AS content_length FROM t",
        "html_description": f"WITH t AS (SELECT doc_id, {_TEXT} AS t, {_stripped(_unescaped(_META))} AS m FROM {_HTML}) SELECT doc_id, CASE WHEN m <> '' THEN m WHEN length(t) > 200 THEN t[1:200] || '...' ELSE t END AS description FROM t",
        "html_links": f"""WITH h AS (SELECT doc_id, regexp_extract(url, '^[^:]+://[^/]+') AS origin, unnest(regexp_extract_all({_SEEN}, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM {_HTML}),
            j AS (SELECT doc_id, lower(origin) AS origin, trim({_unescaped('href')}) AS href FROM h)
            SELECT DISTINCT doc_id, regexp_replace(origin, '^(http://[^/]*):80$|^(https://[^/]*):443$', '\\1\\2') || CASE WHEN href = '/' THEN '/' ELSE regexp_replace(href, '/+$', '') END AS url FROM j WHERE href <> '' AND NOT starts_with(href, '#')""",
        "html_directives": f"SELECT doc_id, regexp_matches(html_text, '(?is)<meta[^>]*name=[\"'']robots[\"''][^>]*noindex') AS noindex, regexp_matches(html_text, '(?is)<meta[^>]*name=[\"'']robots[\"''][^>]*nofollow') AS nofollow FROM {_HTML}",
        "text_tokens": f"""WITH c AS (SELECT doc_id, regexp_split_to_array(lower(content_text), '[ \\t\\n\\r\\f\\x{{0b}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+') AS ws FROM ({_ONE}) WHERE content_text IS NOT NULL)
            SELECT doc_id, CAST(len(list_filter(ws, lambda w: regexp_full_match(regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '(?:n[''’]t|[''’](?:s|re|ve|ll|d|m))$', ''), '\\p{{L}}+'))) AS BIGINT) AS tokens FROM c""",
        "dedup_exact": f"WITH one AS (SELECT DISTINCT doc_id, url, content_fingerprint FROM content_score_input), r AS (SELECT *, row_number() OVER (PARTITION BY content_fingerprint ORDER BY doc_id) AS n FROM one) SELECT doc_id, url FROM r WHERE n = 1 OR content_fingerprint IS NULL",
        "dedup_documents": "WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM r WHERE n = 1 OR text IS NULL",
    }
