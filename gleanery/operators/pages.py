"""From fetched pages to index records, links and graph rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import text as T
from gleanery.functions import url as U


def canonical_url(url: Column, markup: Column) -> Column:
    """The page's canonical link in normal form, else its own URL in normal form."""
    named = F.nullif(H.canonical(markup), F.lit(""))
    return F.coalesce(U.normalized(U.resolved(url, named)), U.normalized(url), url)


def extracted(pages: DataFrame) -> DataFrame:
    """One record for each page (url, html, robots header): canonical url, fields, links, noindex and nofollow."""
    said = H.directives(F.col("html"), F.col("robots"))
    base = pages.filter("html is not null").select(canonical_url(F.col("url"), F.col("html")).alias("url"), "html", H.text(F.col("html")).alias("_text"), said.alias("_said"))
    return base.select(
        "url",
        H.title(F.col("html")).alias("title"),
        H.description(F.col("html"), F.col("_text")).alias("description"),
        H.content(F.col("_text")).alias("content"),
        T.tokens(F.col("_text")).alias("words"),
        H.word_count(F.col("_text")).alias("word_count"),
        F.sha1("_text").alias("content_fingerprint"),
        H.hrefs(F.col("html")).alias("hrefs"),
        F.array_contains("_said", "noindex").alias("noindex"),
        F.array_contains("_said", "nofollow").alias("nofollow"),
    )


def indexed(records: DataFrame) -> DataFrame:
    """Records that enter the index."""
    return records.filter(~F.col("noindex")).drop("hrefs", "noindex", "nofollow")


def links(records: DataFrame) -> DataFrame:
    """src and dst of every link that may be followed, repeats kept for the frontier."""
    flat = records.filter(~F.col("nofollow")).select(F.col("url").alias("src"), F.explode("hrefs").alias("_h"))
    return flat.select("src", U.present(U.normalized(U.resolved(F.col("src"), F.col("_h")))).alias("dst"))


def graph_sources(records: DataFrame) -> DataFrame:
    """Pages with a row in the link graph: all but those neither indexed nor followed."""
    return records.filter(~(F.col("noindex") & F.col("nofollow"))).select("url").distinct()
