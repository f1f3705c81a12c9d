"""Queries pN_ over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.site import site_of
from gleanery.llm import boilerplate, capping, distinctive, leaks, leximin, lines, near, residue, stuffing, tokens
from gleanery.sources.tables import table

#: Share of all pages that one site may keep.
SITE_SHARE = 1 / 40
SCORES = ["pagerank", "panda_score", "penguin_score", "relevance_score"]


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "content_score_input"), table(spark, folder, "link_profile")


def _rounded(column: str, places: int) -> F.Column:
    return F.floor(F.col(column) * 10**places + 0.5) / 10.0**places


def p1_measures(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.judged(*_pages(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(*_pages(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deleted_lines(*_pages(spark, folder))


def p2_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return lines.frequent_sequences(*_pages(spark, folder))


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeated_lines(*_pages(spark, folder))


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    scored = distinctive.distinctive_terms(table(spark, folder, "doc_words"))
    return scored.select("doc_id", "term", "tf", "doc_freq", _rounded("score", 3).alias("score"))


def _by_site(spark: SparkSession, folder: str) -> DataFrame:
    info = table(spark, folder, "doc_info").select("doc_id", F.col("url").alias("_url"), F.col("panda_score").alias("score"))
    joined = info.join(lines.page_sites(table(spark, folder, "link_profile")), "doc_id", "left")
    return joined.select("doc_id", "score", F.coalesce("site", site_of(F.lit(None).cast("string"), F.col("_url"))).alias("site"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return capping.over_limit(_by_site(spark, folder), "site", share=SITE_SHARE)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.similar_pairs(table(spark, folder, "doc_words"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near.groups(table(spark, folder, "doc_words"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.not_main_lines(*_pages(spark, folder))


def p6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_text(*_pages(spark, folder))


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the results, read from the page's own record where it has them.

    A result's copy of a score counts only within the score's range: another
    scale or a mark for a missing measurement is no measurement.
    """
    info = table(spark, folder, "doc_info").groupBy("doc_id").agg(*[F.max(c).alias(f"_{c}") for c in SCORES[:3]])
    within = {"pagerank": (0.0, 1.0), "panda_score": (0.0, 1.0), "penguin_score": (0.0, 1e6), "relevance_score": (0.0, 1.0)}
    own = {c: F.when(F.col(c).between(*within[c]), F.col(c)) for c in SCORES}
    joined = table(spark, folder, "rank_input").join(info, "doc_id", "left")
    return joined.select("query_text", "doc_id", *[F.coalesce(*([F.col(f"_{c}")] if c in SCORES[:3] else []), own[c]).alias(c) for c in SCORES])


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    ordered = leximin.leximin_order(_measured(spark, folder), "query_text", SCORES)
    return ordered.select("query_text", "doc_id", F.element_at("vector", 1).alias("weakest"), "position")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode(p8_ids(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(table(spark, folder, "documents"))


def p10_templates(spark: SparkSession, folder: str) -> DataFrame:
    return residue.templates(residue.mined(table(spark, folder, "documents"))).filter("points > 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_measures, p2_found, p2_sequences, p2_clean, p3_terms, p4_found, p5_found, p5_groups, p6_found, p6_main_text, p7_order, p8_ids, p8_decoded, p9_found, p10_found, p10_templates]
    return {f.__name__: f for f in named}


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(trim({})), ':[0-9]*$', ''), '\\.+$', ''), '^www\\.', '')"
_HOST = "regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', '')"
_SITE = f"CASE WHEN domain IS NOT NULL AND {_CLEAN.format('domain')} NOT IN ('', 'unknown') THEN {_CLEAN.format('domain')} ELSE {_CLEAN.format(_HOST)} END"
_SITES = f"SELECT DISTINCT doc_id, {_SITE} AS site FROM link_profile"
_LOG = "CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0.0 END"


def _likelihood() -> str:
    a, b, c, d = "a", "b", "c", "d"
    cells = " + ".join(_LOG.format(x) for x in (a, b, c, d))
    margins = " + ".join(_LOG.format(x) for x in ("a + b", "c + d", "a + c", "b + d"))
    return f"greatest(2 * (({cells}) - ({margins}) + {_LOG.format('a + b + c + d')}), 0.0)"


def oracle_sql() -> dict[str, str]:
    lined = rf"""
        WITH sites AS ({_SITES}),
        pages AS (SELECT doc_id, any_value(content_text) AS text FROM content_score_input WHERE content_text IS NOT NULL GROUP BY doc_id),
        cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM pages),
        numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM cut),
        keyed AS (SELECT site, doc_id, CAST(line_no AS INTEGER) AS line_no, trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{{L}}]+', ' ', 'g')) AS key FROM numbered JOIN sites USING (doc_id)),
        frequent AS (SELECT site, key FROM keyed WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT doc_id) >= {lines.MIN_SUPPORT})
        SELECT doc_id, line_no FROM keyed JOIN frequent USING (site, key)"""
    terms = f"""
        WITH once AS (SELECT doc_id, any_value(words) AS words FROM doc_words WHERE len(words) > 0 GROUP BY doc_id),
        long AS (SELECT doc_id, unnest(words) AS term FROM once),
        counts AS (SELECT doc_id, term, count(*) AS tf FROM long WHERE term IS NOT NULL GROUP BY doc_id, term),
        docs AS (SELECT doc_id, sum(tf) AS n FROM counts GROUP BY doc_id),
        terms AS (SELECT term, sum(tf) AS n, count(*) AS doc_freq FROM counts GROUP BY term),
        whole AS (SELECT sum(tf) AS n FROM counts),
        cells AS (SELECT doc_id, term, tf, doc_freq, CAST(tf AS DOUBLE) AS a, CAST(terms.n - tf AS DOUBLE) AS b, CAST(docs.n - tf AS DOUBLE) AS c, CAST(whole.n - docs.n - terms.n + tf AS DOUBLE) AS d
            FROM counts JOIN docs USING (doc_id) JOIN terms USING (term), whole)
        SELECT doc_id, term, tf, doc_freq, floor((CASE WHEN a * (b + d) >= b * (a + c) THEN 1 ELSE -1 END) * {_likelihood()} * 1000 + 0.5) / 1000.0 AS score FROM cells"""
    capped = f"""
        WITH sites AS ({_SITES}),
        pages AS (SELECT doc_id, site, coalesce(max(panda_score), 0.5) AS score FROM doc_info JOIN sites USING (doc_id) GROUP BY doc_id, site),
        ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY site ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM pages)
        SELECT doc_id FROM ranked WHERE place > greatest(1, n // 40)"""
    pairs = """
        WITH sets AS (SELECT doc_id, list_distinct(any_value(words)) AS words FROM doc_words WHERE len(words) > 0 GROUP BY doc_id),
        long AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM sets),
        common AS (SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM long x JOIN long y ON x.term = y.term AND x.doc_id < y.doc_id AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4 GROUP BY 1, 2)
        SELECT doc_id_a, doc_id_b FROM common WHERE k * 5 >= (n + m - k) * 4"""
    own = {"pagerank": "coalesce(_pagerank, CASE WHEN pagerank BETWEEN 0 AND 1 THEN pagerank END)", "panda_score": "coalesce(_panda, CASE WHEN panda_score BETWEEN 0 AND 1 THEN panda_score END)"}
    own |= {"penguin_score": "coalesce(_penguin, CASE WHEN penguin_score BETWEEN 0 AND 1e6 THEN penguin_score END)", "relevance_score": "CASE WHEN relevance_score BETWEEN 0 AND 1 THEN relevance_score END"}
    order = f"""
        WITH info AS (SELECT doc_id, max(pagerank) AS _pagerank, max(panda_score) AS _panda, max(penguin_score) AS _penguin FROM doc_info GROUP BY doc_id),
        items AS (SELECT query_text, doc_id, {", ".join(f"max({own[c]}) AS {c}" for c in SCORES)} FROM rank_input LEFT JOIN info USING (doc_id) GROUP BY query_text, doc_id),
        placed AS (SELECT query_text, doc_id, {", ".join(f"CASE WHEN {c} IS NULL THEN 0.5 ELSE ((rank() OVER (PARTITION BY query_text, {c} IS NULL ORDER BY {c}) - 1) + (count(*) OVER (PARTITION BY query_text, {c})) / 2.0::DOUBLE) / (count({c}) OVER (PARTITION BY query_text)) END AS {c}" for c in SCORES)} FROM items),
        vectors AS (SELECT query_text, doc_id, list_sort([CAST(pagerank AS DOUBLE), CAST(panda_score AS DOUBLE), CAST(penguin_score AS DOUBLE), CAST(relevance_score AS DOUBLE)]) AS v FROM placed)
        SELECT query_text, doc_id, v[1] AS weakest, row_number() OVER (PARTITION BY query_text ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, v[4] DESC, doc_id) AS position FROM vectors"""
    clean = rf"""
        WITH found AS ({lined}),
        pages AS (SELECT doc_id, any_value(content_text) AS text FROM content_score_input GROUP BY doc_id),
        cut AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM pages WHERE text IS NOT NULL),
        numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM cut),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM numbered WHERE (doc_id, line_no) NOT IN (SELECT doc_id, line_no FROM found) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS content_text FROM pages LEFT JOIN kept USING (doc_id)"""
    grouped = """
        WITH RECURSIVE raw AS (SELECT doc_id, list_sort(list_distinct(list_filter(any_value(words), lambda w: w IS NOT NULL))) AS words FROM doc_words WHERE words IS NOT NULL GROUP BY doc_id),
        sets AS (SELECT doc_id, words, min(doc_id) OVER (PARTITION BY words) AS rep FROM raw WHERE len(words) > 0),
        long AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM sets WHERE doc_id = rep),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM long x JOIN long y ON x.term = y.term AND x.doc_id <> y.doc_id AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4 GROUP BY 1, 2),
        edges AS (SELECT a, b FROM common WHERE k * 5 >= (n + m - k) * 4),
        r(node, label) AS (SELECT DISTINCT rep, rep FROM sets UNION SELECT e.b, r.label FROM r JOIN edges e ON e.a = r.node),
        g AS (SELECT node, min(label) AS group_id FROM r GROUP BY node), l AS (SELECT a, count(*) AS links FROM edges GROUP BY a)
        SELECT doc_id, rep AS class_id, group_id, coalesce(links, 0) AS links FROM sets JOIN g ON g.node = rep LEFT JOIN l ON l.a = rep"""
    decoded = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    return {"p8_decoded": decoded, "p2_clean": clean, "p5_groups": grouped, "p2_found": lined, "p3_terms": terms, "p4_found": capped, "p5_found": pairs, "p7_order": order}
