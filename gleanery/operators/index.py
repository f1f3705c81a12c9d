"""Inverted index: postings, statistics, term weights, point lookups.

Postings stay flat (term, doc_id); the compact form with one array a term is
built only where it is asked for, since a frequent term's array grows with the
corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postings(records: DataFrame) -> DataFrame:
    """Distinct (term, doc_id) of records with an array ``words``."""
    return records.select("doc_id", F.explode(F.array_distinct("words")).alias("term")).filter("term is not null").select("term", "doc_id").distinct()


def compact(flat: DataFrame) -> DataFrame:
    """term and the sorted array of its documents."""
    return flat.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def document_frequency(flat: DataFrame) -> DataFrame:
    return flat.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def index_stats(flat: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, terms, and mean (2 decimals), largest and smallest postings length."""
    lengths = document_frequency(flat).agg(
        F.count(F.lit(1)).alias("terms"), (F.floor(F.coalesce(F.avg("doc_freq"), F.lit(0.0)) * 100 + 0.5) / 100.0).alias("avg_postings"), F.coalesce(F.max("doc_freq"), F.lit(0)).alias("max_postings"), F.coalesce(F.min("doc_freq"), F.lit(0)).alias("min_postings")
    )
    n = documents.agg(F.count_distinct("doc_id")).scalar()
    return lengths.select(n.alias("documents"), "*")


def popular_terms(flat: DataFrame, limit: int = 50) -> DataFrame:
    """The terms in most documents, at most 500; ties by term."""
    return document_frequency(flat).orderBy(F.desc("doc_freq"), "term").limit(min(limit, 500))


def idf(flat: DataFrame, documents: DataFrame) -> DataFrame:
    """ln(1 + N / (df + 1)) of each term."""
    n = documents.agg(F.count_distinct("doc_id")).scalar()
    return document_frequency(flat).select("term", "doc_freq", F.log(1 + n / (F.col("doc_freq") + 1)).alias("idf"))


def match_any(flat: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of the documents with any of the terms."""
    return flat.filter(F.col("term").isin(*terms)).select("doc_id").distinct()


def match_all(flat: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of the documents with all of the terms; no terms match nothing."""
    wanted = sorted(set(terms))
    return flat.filter(F.col("term").isin(*wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")


def bm25(records: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75, mean_length: float = 300.0) -> DataFrame:
    """doc_id and bm25 of the documents with any of the terms.

    The mean length is a constant; idf is ln(1 + N / (df + 1)). Only occurrences of the query's
    terms are exploded, so a shuffle carries one row for each document and term asked for.
    """
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))])
    lengths = records.select("doc_id", F.size("words").alias("length"), F.filter("words", lambda w: F.array_contains(wanted, w)).alias("hits"))
    tf = lengths.select("doc_id", "length", F.explode("hits").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = records.agg(F.count_distinct("doc_id")).scalar()
    # the query's terms bound the small side
    weighed = tf.join(F.broadcast(df), "term")
    weight = F.log(1 + n / (F.col("df") + 1)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean_length))
    return weighed.groupBy("doc_id").agg(F.sum(weight).alias("bm25"))


def exact_duplicates(records: DataFrame, fingerprint: str, order: list[Column]) -> DataFrame:
    """Records that are the first of their fingerprint in ``order``; null fingerprints are all kept.

    The first is found by an aggregation with partial results, not by sorting groups.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = records.filter(F.col(fingerprint).isNull())
    one = records.filter(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.min_by(F.struct(*[F.col(c) for c in records.columns]), key).alias("_r")).select("_r.*")
    return one.unionByName(rest)
