"""Keyword search: query terms, relevance, rank, pages of results, suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import ranking
from gleanery.functions.numbers import rounded
from gleanery.functions.text import STOPWORDS, porter
from gleanery.functions.url import netloc
from gleanery.operators.index import document_frequency, match_all, match_any

MAX_RESULTS = 100
# Phrases of titles and descriptions of mere front pages.
FRONT_PAGES = ("news.ycombinator", "news | hacker", "new comments", "latest news", "breaking news", "trending now", "hot news")


def parse_query(text: str, stemmed: bool = True) -> list[str]:
    """Terms of a query, in order, repeats kept."""
    import re

    words = [re.sub(r"(?:n['’]t|['’](?:s|re|ve|ll|d|m))$", "", w.strip(".,;:!?\"'()[]{}«»“”„…-–—")) for w in text.lower().split()]
    words = [w for w in words if w.isalpha() and w not in STOPWORDS]
    return [porter(w) for w in words] if stemmed else words


def _starts(text: Column, stem: str) -> Column:
    """Words of ``text`` that start with ``stem``."""
    return F.regexp_count(text, F.lit(r"(?:^|[^\p{L}\p{N}_])\Q" + stem + r"\E"))


def relevance(terms: list[str], title: Column, description: Column, content: Column | None = None) -> Column:
    """Relevance of a document to query terms, 0 to 1 with 4 decimals.

    Words starting with a term count in the title, the description and the full
    text (all of them joined); a front page and a document without matches have 0,
    matches in the content only 0.25.
    """
    if not terms:
        return F.lit(0.0)
    t, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, description))
    parts = [F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))] + ([F.coalesce(content, F.lit(""))] if content is not None else [])
    whole = F.lower(F.concat_ws(" ", *parts))
    count = lambda x: sum((_starts(x, s) for s in terms), F.lit(0))
    nt, nd, nc = count(t), count(d), count(whole)
    front = F.lit(False)
    for phrase in FRONT_PAGES:
        front = front | t.contains(phrase) | d.contains(phrase)
    score = nt * 8.0 + nd * 3.0 * 0.7 + nc * 0.3
    full = F.least(F.lit(1.0), F.log(1 + score) / F.log(F.lit(15.0)))
    only_content = F.when(nc < 1, 0.0).otherwise(0.25)
    return F.when(front, 0.0).otherwise(F.when((nt == 0) & (nd == 0), only_content).otherwise(rounded(full)))


def ranked(documents: DataFrame, postings: DataFrame, terms: list[str], domain: str | None = None, strategy: str = "relevance_first", mode: str = "any", content: str | None = None) -> DataFrame:
    """All results of a query with relevance_score and rank_score, unordered.

    ``documents`` has doc_id, url, title, description and the scores. The
    postings filter reaches the scan; the domain filter is applied before relevance is computed.
    """
    hits = match_all(postings, terms) if mode == "all" else match_any(postings, terms)
    rows = documents
    if domain:
        rows = rows.filter(F.contains(F.lower(netloc(F.col("url"))), F.lit(domain.lower())))
    found = rows.join(hits, "doc_id", "left_semi").withColumn("relevance_score", relevance(terms, F.col("title"), F.col("description"), F.col(content) if content else None))
    kept = found.filter("relevance_score > 0").withColumn("rank_score", ranking.rank_score(strategy))
    scores = [ranking.filled(s).alias(s) for s in ranking.SIGNALS]
    return kept.select("doc_id", "url", "title", "description", *scores, "rank_score")


def page_of(results: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """One page of results by rank, ties by doc_id; sizes are limited to 100, pages start at 1."""
    size, page = max(1, min(size, MAX_RESULTS)), max(1, page)
    return results.orderBy(F.desc("rank_score"), "doc_id").offset((page - 1) * size).limit(size)


def suggestions(vocabulary: DataFrame, words: DataFrame, distance: int = 2, most: int = 5) -> DataFrame:
    """word, term and distance: the closest terms of each word, ties by term.

    A word of the vocabulary suggests itself. Otherwise lengths may differ by at most
    ``distance``; the words asked about are a query's, a handful, and are broadcast
    against the vocabulary, which is read once and never shuffled whole.
    """
    asked = words.select("word").distinct()
    d = F.levenshtein(F.col("word"), F.col("term"), distance)
    near = vocabulary.join(F.broadcast(asked), F.abs(F.length("word") - F.length("term")) <= distance).withColumn("distance", d).filter(F.col("distance") >= 0)
    # per word the first few: pre-aggregated, so no word's candidates meet in one place
    order = F.struct("distance", "term")
    best = near.groupBy("word", F.pmod(F.xxhash64("term"), F.lit(64)).alias("_salt")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("_c"))
    merged = best.groupBy("word").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_c"))), 1, most).alias("_c"))
    exact = F.filter("_c", lambda c: c["distance"] == 0)
    return merged.select("word", F.explode(F.when(F.size(exact) > 0, exact).otherwise(F.col("_c"))).alias("_c")).select("word", "_c.term", "_c.distance")


@dataclass
class SearchResult:
    """A page of results, their number, and suggestions when no term is in the index."""

    results: DataFrame
    total: int
    pages: int
    suggestions: list[str]
    message: str


def search(documents: DataFrame, postings: DataFrame, query: str, page: int = 1, num_results: int = 10, domain: str | None = None, strategy: str = "relevance_first", stemmed: bool = True, mode: str = "any") -> SearchResult:
    """Runs a query; an empty query raises ``ValueError``."""
    if not query or not query.strip():
        raise ValueError("a query is required")
    size = max(1, min(num_results, MAX_RESULTS))
    terms = parse_query(query, stemmed)
    if not terms:
        return SearchResult(documents.limit(0), 0, 0, [], "no terms in the query")
    everything = ranked(documents, postings, terms, domain, strategy, mode)
    total = everything.count()
    proposed: list[str] = []
    if not total and match_any(postings, terms).isEmpty():
        spark = documents.sparkSession
        asked = spark.createDataFrame([(t,) for t in terms], "word string")
        rows = suggestions(document_frequency(postings).select("term"), asked, most=3).orderBy("word", "distance", "term").limit(10 * MAX_RESULTS).collect()
        proposed = list(dict.fromkeys(r.term for r in rows))
    return SearchResult(page_of(everything, page, size), total, -(-total // size), proposed, "" if total else "no results")


def explain(documents: DataFrame, url: str, strategy: str = "relevance_first") -> DataFrame:
    """At most one row: the document of exactly this URL with its scores, rank and explanation."""
    found = documents.filter(F.col("url") == url)
    if "relevance_score" not in documents.columns:
        found = found.withColumn("relevance_score", F.lit(ranking.DEFAULTS["relevance_score"]))
    scored = found.withColumn("rank_score", ranking.rank_score(strategy)).withColumn("explanation", ranking.explanation(strategy))
    return scored.orderBy("doc_id").limit(1).select("doc_id", "url", *[ranking.filled(s).alias(s) for s in ranking.SIGNALS], "rank_score", "explanation")


def suggest(postings: DataFrame, query: str, most: int = 10) -> list[str]:
    """Up to ``most`` distinct terms close to the query's, five a term; a query of one letter has none."""
    if len(query.strip()) < 2:
        return []
    terms = parse_query(query)
    if not terms:
        return []
    spark = postings.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "word string")
    rows = suggestions(document_frequency(postings).select("term"), asked).orderBy("word", "distance", "term").limit(5 * len(terms)).collect()
    return sorted({r.term for r in rows})[:most]


def ranking_info() -> dict:
    """Weights by strategy and the thresholds as they are used."""
    return {"strategies": {k: dict(zip(ranking.SIGNALS, v)) for k, v in ranking.STRATEGIES.items()}, "defaults": ranking.DEFAULTS, "pagerank_ceiling": ranking.PAGERANK_CEILING}
