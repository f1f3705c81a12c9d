"""Queries on the index, search and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import ranking as R
from gleanery.operators import index as I
from gleanery.operators import search as S
from gleanery.plans.text import _r
from gleanery.sources.tables import table

QUERY = "garden bridge harbour"
TERMS = S.parse_query(QUERY, stemmed=False)
MISSPELT = ["brigde", "gardn", "harbuor", "market", "tyer", "windwo"]


def _words(spark, d):
    return table(spark, d, "doc_words").select("doc_id", "words").filter("words is not null")


def _info(spark, d):
    return table(spark, d, "doc_info").distinct()


def inverted_index(spark, d):
    return I.postings(_words(spark, d))


def inverted_index_compact(spark, d):
    compact = I.compact(inverted_index(spark, d))
    return compact.select("term", F.size("doc_ids").cast("long").alias("n"), F.element_at("doc_ids", 1).alias("first"), F.element_at("doc_ids", -1).alias("last"))


def index_stats(spark, d):
    return I.index_stats(inverted_index(spark, d), _info(spark, d))


def popular_terms(spark, d):
    return I.popular_terms(inverted_index(spark, d))


def idf(spark, d):
    x = I.idf(inverted_index(spark, d), _info(spark, d))
    return x.select("term", "doc_freq", (F.floor(F.col("idf") * 1e6 + 0.5) / 1e6).alias("idf"))


def match_any(spark, d):
    return I.match_any(inverted_index(spark, d), TERMS)


def match_all(spark, d):
    return I.match_all(inverted_index(spark, d), TERMS[:2])


def bm25(spark, d):
    one = _words(spark, d).dropDuplicates(["doc_id"])
    return I.bm25(one, TERMS).select("doc_id", (F.floor(F.col("bm25") * 1e6 + 0.5) / 1e6).alias("bm25"))


def relevance(spark, d):
    return _info(spark, d).select("doc_id", S.relevance(TERMS, F.col("title"), F.col("description")).alias("relevance"))


def relevance_content(spark, d):
    """Relevance over the stored content as well, scored before anything is joined."""
    info = _info(spark, d).select("doc_id", F.col("title").alias("_t"), "description")
    pages = table(spark, d, "content_score_input").select("doc_id", "content_text").dropDuplicates(["doc_id"])
    joined = pages.join(info, "doc_id")
    return joined.select("doc_id", S.relevance(TERMS, F.col("_t"), F.col("description"), F.col("content_text")).alias("relevance"))


def search_all(spark, d):
    return S.ranked(_info(spark, d), inverted_index(spark, d), TERMS)


def search(spark, d):
    return S.page_of(search_all(spark, d), 1, 10)


def search_page(spark, d):
    return S.page_of(search_all(spark, d), 2, 5)


def search_stemmed(spark, d):
    from gleanery.functions.text import tokens, with_stems

    pages = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    flat = with_stems(pages).select("term", "doc_id").distinct()
    docs = table(spark, d, "documents").select("doc_id", "url", "title", F.substring("text", 1, 200).alias("description"), "text", *[F.lit(v).alias(s) for s, v in R.DEFAULTS.items()])
    return S.page_of(S.ranked(docs.drop("relevance_score"), flat, S.parse_query("gardens and bridges"), strategy="relevance_first", content="text"), 1, 10)


def filter_domain(spark, d):
    return S.ranked(_info(spark, d), inverted_index(spark, d), TERMS, domain="Docs.").select("doc_id", "url", "rank_score")


def project_result(spark, d):
    return _info(spark, d).select("doc_id", "url", "title", "description", *[R.filled(s).alias(s) for s in R.SIGNALS[:3]])


def suggest(spark, d):
    vocabulary = I.document_frequency(inverted_index(spark, d)).select("term")
    asked = spark.createDataFrame([(w,) for w in MISSPELT], "word string")
    return S.suggestions(vocabulary, asked)


def _results(spark, d):
    return table(spark, d, "rank_input").distinct()


def minmax_norm(spark, d):
    info = _info(spark, d).withColumn("pagerank", R.filled("pagerank"))
    low, high = info.agg(F.min("pagerank")).scalar(), info.agg(F.max("pagerank")).scalar()
    x = R.minmax(F.col("pagerank"), low, high)
    return info.select("doc_id", (F.floor(x * 1e6 + 0.5) / 1e6).alias("norm"))


def rank_combined(spark, d):
    return _results(spark, d).select("query_text", "doc_id", R.combined().alias("combined"))


def rank_thresholds(spark, d):
    return _results(spark, d).select("query_text", "doc_id", R.threshold_factor().alias("factor"))


def _ranked(strategy):
    def query(spark, d):
        return _results(spark, d).select("query_text", "doc_id", R.rank_score(strategy).alias("rank_score"))

    query.__name__ = f"rank_{strategy}"
    return query


RANKED = [_ranked(s) for s in R.STRATEGIES]


def explain(spark, d):
    """Explanation of every page's rank for the query."""
    found = search_all(spark, d)
    return found.select("doc_id", "url", "rank_score", R.explanation().alias("explanation"))


def explain_url(spark, d):
    """Explanation of the page with the smallest URL."""
    info = _info(spark, d)
    first = info.orderBy("url").select("url").first()
    return S.explain(info, first.url if first else "").select("doc_id", "url", "rank_score", "explanation")


def suggest_api(spark, d):
    return spark.createDataFrame([(t,) for t in S.suggest(inverted_index(spark, d), "gardem brigde")], "term string")


def ranking_info(spark, d):
    rows = [(s, n, float(w)) for s, weights in S.ranking_info()["strategies"].items() for n, w in weights.items()]
    return spark.createDataFrame(rows, "strategy string, signal string, weight double")


NAMES = [
    inverted_index, inverted_index_compact, index_stats, popular_terms, idf, match_any, match_all, bm25, relevance, relevance_content, search_all, search, search_page, search_stemmed, filter_domain, project_result, suggest, minmax_norm, rank_combined, rank_thresholds, *RANKED, explain, explain_url, suggest_api, ranking_info,
]

_POST = "SELECT DISTINCT unnest(words) AS term, doc_id FROM doc_words"
_FLAT = f"(SELECT term, doc_id FROM ({_POST}) WHERE term IS NOT NULL)"
_INFO = "(SELECT DISTINCT * FROM doc_info)"
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _starts(x: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, '(?:^|[^\\p{{L}}\\p{{N}}_]){t}'))" for t in TERMS) + ")"


def _relevance(source: str, content: str = "") -> str:
    front = " OR ".join(f"contains({c}, '{p}')" for p in S.FRONT_PAGES for c in ("t", "d"))
    whole = "lower(coalesce(title, '') || ' ' || coalesce(description, '')" + (f" || ' ' || coalesce({content}, '')" if content else "") + ")"
    return f"""rel AS (SELECT *, CASE WHEN {front} THEN 0.0::DOUBLE WHEN nt = 0 AND nd = 0 THEN CASE WHEN nc < 1 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END
        ELSE {_r('least(1.0::DOUBLE, ln(1 + (nt * 8.0::DOUBLE + nd * 3.0::DOUBLE * 0.7::DOUBLE + nc * 0.3::DOUBLE)) / ln(15.0::DOUBLE))')} END AS relevance
        FROM (SELECT *, {_starts('t')} AS nt, {_starts('d')} AS nd, {_starts('w')} AS nc FROM (SELECT *, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d, {whole} AS w FROM {source})))"""


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_FILLED = {s: f"coalesce({s}, {R.DEFAULTS[s]}::DOUBLE)" for s in R.SIGNALS}


def _combined(strategy: str, filled: dict[str, str] = _FILLED) -> str:
    scaled = [_clamp(f"({filled['pagerank']} - 0.0::DOUBLE) / 0.1::DOUBLE"), *[_clamp(filled[s]) for s in R.SIGNALS[1:]]]
    return _r("0.0::DOUBLE + " + " + ".join(f"{x} * {w}::DOUBLE" for x, w in zip(scaled, R.STRATEGIES[strategy])), 6)


_FACTOR = f"(CASE WHEN {_FILLED['panda_score']} < 0.3::DOUBLE THEN 0.3 WHEN {_FILLED['penguin_score']} < 0.2::DOUBLE THEN 0.5 WHEN {_FILLED['panda_score']} > 0.8::DOUBLE AND {_FILLED['penguin_score']} > 0.8::DOUBLE THEN 1.2 ELSE 1.0 END)::DOUBLE"
_RESULTS = "(SELECT DISTINCT * FROM rank_input)"


def _search(extra: str = "") -> str:
    scores = ", ".join(f"{_FILLED[s]} AS {s}" for s in R.SIGNALS[:3])
    return f"""WITH {_relevance(_INFO)}, hits AS (SELECT DISTINCT doc_id FROM {_FLAT} WHERE term IN ({_LIST})),
        kept AS (SELECT *, relevance AS relevance_score FROM rel WHERE relevance > 0 AND doc_id IN (SELECT doc_id FROM hits) {extra}),
        ranked AS (SELECT doc_id, url, title, description, {scores}, relevance_score, {_r(f"{_combined('relevance_first')} * {_FACTOR}", 6)} AS rank_score FROM kept)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "inverted_index": f"SELECT * FROM {_FLAT}",
        "inverted_index_compact": f"SELECT term, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM {_FLAT} GROUP BY term",
        "index_stats": f"WITH f AS (SELECT term, count(*) AS n FROM {_FLAT} GROUP BY term) SELECT (SELECT count(DISTINCT doc_id) FROM doc_info) AS documents, count(*) AS terms, floor(avg(n) * 100 + 0.5) / 100.0 AS avg_postings, max(n) AS max_postings, min(n) AS min_postings FROM f",
        "popular_terms": f"SELECT term, count(*) AS doc_freq FROM {_FLAT} GROUP BY term ORDER BY doc_freq DESC, term LIMIT 50",
        "idf": f"SELECT term, count(*) AS doc_freq, {_r('ln(1 + (SELECT count(DISTINCT doc_id) FROM doc_info) / CAST(count(*) + 1 AS DOUBLE))', 6)} AS idf FROM {_FLAT} GROUP BY term",
        "match_any": f"SELECT DISTINCT doc_id FROM {_FLAT} WHERE term IN ({_LIST})",
        "match_all": f"SELECT doc_id FROM {_FLAT} WHERE term IN ('{TERMS[0]}', '{TERMS[1]}') GROUP BY doc_id HAVING count(*) = 2",
        "bm25": f"""WITH one AS (SELECT DISTINCT ON (doc_id) doc_id, words FROM doc_words WHERE words IS NOT NULL), l AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM one),
            tf AS (SELECT doc_id, term, count(*) AS f, any_value(n) AS n FROM l WHERE term IN ({_LIST}) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS k FROM tf GROUP BY term)
            SELECT doc_id, {_r("sum(ln(1 + (SELECT count(*) FROM one) / CAST(k + 1 AS DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 300.0::DOUBLE)))", 6)} AS bm25 FROM tf JOIN df USING (term) GROUP BY doc_id""",
        "relevance": f"WITH {_relevance(_INFO)} SELECT doc_id, relevance FROM rel",
        "relevance_content": f"WITH {_relevance('(SELECT DISTINCT i.doc_id, i.title, i.description, c.content_text FROM doc_info i JOIN content_score_input c USING (doc_id))', 'content_text')} SELECT doc_id, relevance FROM rel",
        "search_all": f"{_search()} SELECT * FROM ranked",
        "search": f"{_search()} SELECT * FROM ranked ORDER BY rank_score DESC, doc_id LIMIT 10",
        "search_page": f"{_search()} SELECT * FROM ranked ORDER BY rank_score DESC, doc_id LIMIT 5 OFFSET 5",
        "filter_domain": f"""{_search("AND contains(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), 'docs.')")} SELECT doc_id, url, rank_score FROM ranked""",
        "project_result": f"SELECT doc_id, url, title, description, {', '.join(f'{_FILLED[s]} AS {s}' for s in R.SIGNALS[:3])} FROM {_INFO}",
        "suggest": f"""WITH v AS (SELECT DISTINCT term FROM {_FLAT}), w AS (SELECT unnest([{', '.join(repr(m) for m in MISSPELT)}]) AS word),
            b AS (SELECT term, regexp_replace(term, '[^ -~]', '?', 'g') AS plain FROM v),
            c AS (SELECT word, term, CAST(levenshtein(word, plain) AS INTEGER) AS distance FROM b, w WHERE abs(length(word) - length(term)) <= 2 AND levenshtein(word, plain) <= 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, term) AS n, min(distance) OVER (PARTITION BY word) AS least FROM c) SELECT word, term, distance FROM r WHERE n <= 5 AND (least > 0 OR distance = 0)""",
        "minmax_norm": f"WITH i AS (SELECT doc_id, coalesce(pagerank, 0) AS pagerank FROM {_INFO}), e AS (SELECT min(pagerank) AS l, max(pagerank) AS h FROM i) SELECT doc_id, {_r('CASE WHEN l = h THEN 0.5::DOUBLE ELSE ' + _clamp('(pagerank - l) / (h - l)') + ' END', 6)} AS norm FROM i, e",
        "rank_combined": f"SELECT query_text, doc_id, {_combined('balanced')} AS combined FROM {_RESULTS}",
        "rank_thresholds": f"SELECT query_text, doc_id, {_FACTOR} AS factor FROM {_RESULTS}",
        "ranking_info": " UNION ALL ".join(f"SELECT '{s}' AS strategy, '{n}' AS signal, {w}::DOUBLE AS weight" for s, ws in R.STRATEGIES.items() for n, w in zip(R.SIGNALS, ws)),
    }
    for s in R.STRATEGIES:
        out[f"rank_{s}"] = f"SELECT query_text, doc_id, {_r(f'{_combined(s)} * {_FACTOR}', 6)} AS rank_score FROM {_RESULTS}"
    return out
