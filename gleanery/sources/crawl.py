"""Sources of a crawl besides pages: robots files, sitemaps, legacy JSON files, snapshots."""

from __future__ import annotations

import gzip
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType
from pyspark.sql.window import Window

from gleanery.functions import html as H
from gleanery.functions import url as U
from gleanery.operators.scale import Pointers, cut

# Where sites keep their sitemaps.
SITEMAP_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap1.xml", "/post-sitemap.xml", "/page-sitemap.xml", "/category-sitemap.xml", "/tag-sitemap.xml", "/news-sitemap.xml", "/video-sitemap.xml", "/image-sitemap.xml", "/api/sitemap.xml", "/sitemap.txt", "/sitemap", "/site-map",
)


def sitemap_candidates(origins: DataFrame) -> DataFrame:
    """origin and url of every place where the origin may keep a sitemap."""
    paths = F.array(*[F.lit(p) for p in SITEMAP_PATHS])
    return origins.select("origin").distinct().select("origin", F.explode(F.transform(paths, lambda p: F.concat(F.col("origin"), p))).alias("url"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """origin and normalised url of the Sitemap lines of robots files (origin, text)."""
    lines = robots.select("origin", F.explode(F.split("text", r"\r?\n|\r")).alias("line"))
    named = lines.filter(F.lower(F.trim(F.substring_index("line", ":", 1))) == "sitemap")
    return named.select("origin", U.normalized(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).alias("url")).filter("url is not null").distinct()


def sitemap_queue(robots: DataFrame) -> DataFrame:
    """origin, url and place of the sitemaps to read of each origin (origin, text): those its robots file names, in order, then the usual places, each once at its first place."""
    lines = robots.select("origin", F.posexplode(F.split("text", r"\r?\n|\r")).alias("place", "line"))
    named = lines.filter(F.lower(F.trim(F.substring_index("line", ":", 1))) == "sitemap").select("origin", U.normalized(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).alias("url"), "place")
    usual = robots.select("origin").distinct().select("origin", F.posexplode(F.array(*[F.lit(p) for p in SITEMAP_PATHS])).alias("place", "_p"))
    # a robots file has fewer lines than this
    later = usual.select("origin", U.normalized(F.concat("origin", "_p")).alias("url"), (F.col("place") + (1 << 30)).alias("place"))
    first = named.unionByName(later).filter("url is not null").groupBy("origin", "url").agg(F.min("place").alias("_at"))
    # an origin has no more sitemaps than its robots file has lines
    return first.select("origin", "url", (F.row_number().over(Window.partitionBy("origin").orderBy("_at")) - 1).alias("place"))


def robots_allowed(agent: str):
    """A function of (robots text, url): whether the file lets the agent fetch the URL; no or broken files let it."""

    @F.pandas_udf(BooleanType())
    def allowed(robots: pd.Series, url: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsers: dict = {}

        def one(text, u):
            if not text or u is None:
                return True
            if text not in parsers:
                p = RobotFileParser()
                try:
                    p.parse(text.splitlines())
                except Exception:
                    p = None
                parsers[text] = p
            p = parsers[text]
            try:
                return p is None or p.can_fetch(agent, u)
            except Exception:
                return True

        return pd.Series([one(t, u) for t, u in zip(robots, url)], dtype=bool)

    return allowed


def crawl_delay(text: Column) -> Column:
    """Seconds that the file's first Crawl-delay line asks for, null without one."""
    return F.nullif(F.regexp_extract(text, r"(?im)^\s*crawl-delay\s*:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def sitemap_kind(url: Column, content_type: Column, text: Column) -> Column:
    """xml, text, html or bad, decided in this order."""
    start = F.lower(F.ltrim(text))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    xml = kind.contains("xml") | start.startswith("<?xml") | start.startswith("<urlset") | start.startswith("<sitemapindex")
    plain = F.lower(U.path(url)).endswith(".txt") | kind.contains("text/plain")
    page = kind.contains("html") | F.substring(start, 1, 400).contains("<html")
    return F.when(xml, "xml").when(plain, "text").when(page, "html").otherwise("bad")


def sitemap_entries(maps: DataFrame) -> DataFrame:
    """sitemap, kind, is_index and url of each entry of fetched sitemaps (url, content_type, text)."""
    rows = maps.select(F.col("url").alias("sitemap"), "text", sitemap_kind(F.col("url"), F.col("content_type"), F.col("text")).alias("kind"))
    loc = F.regexp_extract_all("text", F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    found = F.when(F.col("kind") == "xml", loc).when(F.col("kind") == "text", F.split("text", r"\r?\n|\r")).when(F.col("kind") == "html", H.hrefs(F.col("text")))
    index = (F.col("kind") == "xml") & F.col("text").rlike(r"(?i)<(?:\w+:)?sitemapindex\b")
    # all that needs the text is computed before its entries are rows, which would carry it each through the resolving
    whole = rows.select("sitemap", "kind", index.alias("is_index"), found.alias("_found"))
    urls = whole.select("sitemap", "kind", "is_index", F.explode_outer("_found").alias("_u"))
    # each step is a column of its own, since the next uses it several times
    entries = urls.withColumn("_e", F.nullif(H.unescaped(F.trim(F.col("_u"))), F.lit("")))
    # only pages may link relatively; an entry of another sitemap is an address or nothing
    joined = entries.withColumn("_j", F.when(F.col("kind") == "html", U.resolved(F.col("sitemap"), F.col("_e"))).otherwise(F.col("_e")))
    return joined.select("sitemap", "kind", "is_index", U.normalized(F.col("_j")).alias("url"))


def sitemap_urls(fetched: DataFrame, roots: DataFrame) -> DataFrame:
    """Page URLs reached from the root sitemaps (url) through indexes of indexes, each with its sitemap."""
    # a filter would be pushed below all steps of the address and repeat them, with their table of references, many times
    entries = cut(sitemap_entries(fetched).select("sitemap", "kind", "is_index", U.present(F.col("url")).alias("url")))
    front, seen = roots.select(F.col("url").alias("sitemap")).distinct(), None
    pages = entries.limit(0).select("sitemap", "url")
    # ends, since a sitemap is entered once
    while True:
        seen = front if seen is None else seen.unionByName(front)
        here = entries.join(front, "sitemap")
        pages = pages.unionByName(here.filter("not is_index").select("sitemap", "url"))
        front = cut(here.filter("is_index").select(F.col("url").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti"))
        if front.isEmpty():
            break
    return pages.distinct()


@F.pandas_udf(StringType())
def gunzipped(data: pd.Series) -> pd.Series:
    """Text of a gzip or plain payload, null if it can't be read."""

    def one(b):
        if b is None:
            return None
        try:
            raw = gzip.GzipFile(fileobj=io.BytesIO(b)).read() if bytes(b[:2]) == b"\x1f\x8b" else bytes(b)
            return raw.decode("utf-8", "replace")
        except Exception:
            return None

    return pd.Series([one(b) for b in data], dtype=object)


def html_only(responses: DataFrame) -> DataFrame:
    """Responses whose content type names HTML."""
    return responses.filter(F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html")))


def index_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Postings of a JSON object from terms to arrays of document ids; a broken file is empty."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<long>>")).alias("term", "ids")).select("term", F.explode(F.array_distinct("ids")).alias("doc_id"))


def documents_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON object from document ids to fields, missing scores filled in."""
    fields = "struct<url:string,title:string,description:string,content:string,pagerank:double,panda_score:double,penguin_score:double>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{fields}>")).alias("id", "d"))
    filled = [F.coalesce(f"d.{c}", F.lit(v)).alias(c) for c, v in (("pagerank", 0.0), ("panda_score", 0.5), ("penguin_score", 0.5))]
    return rows.select(F.try_to_number("id", F.lit("999999999999999999")).cast("long").alias("doc_id"), "d.url", "d.title", "d.description", *filled).filter("doc_id is not null")


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: str, max_file_mb: float = 0, max_total_mb: float = 0) -> bool:
    """Writes the tables as a new version and then adds a pointer to it; false if they exceed the limits.

    Readers take the last pointer, so they see the old version or the new one
    whole; pointers are never overwritten, so no interruption loses a version.
    """
    spark = next(iter(tables.values())).sparkSession
    if max_file_mb or max_total_mb:
        sizes = [payload_mb(df) for df in tables.values()]
        if (max_file_mb and max(sizes) > max_file_mb) or (max_total_mb and sum(sizes) > max_total_mb):
            return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}.parquet")
    Pointers(spark, folder).add({"version": version})
    return True


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that the pointer names."""
    version = Pointers(spark, folder).read()["version"]
    return spark.read.parquet(f"{folder}/{version}/{name}.parquet")


def payload_mb(df: DataFrame) -> float:
    """Megabytes of the rows as JSON."""
    return float(df.agg((F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)) / 1e6).alias("mb")).first().mb)
