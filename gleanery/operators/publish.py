"""From a crawl's state to what is served: resuming, when to publish, scores at publication, status."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import links as L
from gleanery.functions import quality as Q
from gleanery.functions import url as U
from gleanery.operators import graph as G
from gleanery.operators.scale import running_total

#: Pages between two publications.
EVERY = 30
#: Events that may wait to be shown; further ones are turned away.
WAITING = 10_000
_STATE = (
    "queue array<string>, visited_urls array<string>, known_urls array<string>, seed_urls array<string>, url_depth_map map<string,int>, url_seed_map map<string,boolean>, "
    "pagerank_graph map<string,array<string>>, content_fingerprints map<string,long>, url_to_doc_id map<string,long>, doc_id_counter long, crawl_count long, last_saved_count long"
)


def state_from_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved crawl state: queue, visited, known, seeds (url), depths (url, depth), flags (url, is_seed), graph (src, dst), owners, documents, counters; a broken file gives empty ones."""
    state = spark.read.text(path, wholetext=True).select(F.from_json("value", _STATE).alias("s")).select("s.*")
    urls = lambda c: state.select(F.explode(c).alias("url"))
    flat = state.select(F.explode("pagerank_graph").alias("src", "_to")).select("src", F.explode("_to").alias("dst"))
    return {
        "queue": urls("queue"), "visited": urls("visited_urls"), "known": urls("known_urls"), "seeds": urls("seed_urls"),
        "depths": state.select(F.explode("url_depth_map").alias("url", "depth")), "flags": state.select(F.explode("url_seed_map").alias("url", "is_seed")), "graph": flat,
        "owners": state.select(F.explode("content_fingerprints").alias("content_fingerprint", "doc_id")), "documents": state.select(F.explode("url_to_doc_id").alias("url", "doc_id")),
        "counters": state.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("doc_id_counter", "crawl_count", "last_saved_count")]),
    }


def _normal(urls: DataFrame) -> DataFrame:
    return urls.select(U.present(U.normalized(F.col("url"))).alias("url")).filter("url is not null").distinct()


def resumed(queue: DataFrame, visited: DataFrame, known: DataFrame, depths: DataFrame, flags: DataFrame, starting: DataFrame) -> dict[str, DataFrame]:
    """The frontier (url, is_seed, depth, priority), visited and known URLs with which a crawl goes on.

    All URLs are normalised; a waiting URL without a saved depth has 0 and without a
    flag is no seed; the starting URLs are known. Several spellings of a URL
    count once, with the least depth and as a seed if one of them is.
    """
    one = lambda df, value, best: df.select(U.present(U.normalized(F.col("url"))).alias("url"), value).groupBy("url").agg(best(value).alias(value))
    waiting = _normal(queue).join(one(depths, "depth", F.min), "url", "left").join(one(flags, "is_seed", F.max), "url", "left")
    seed = F.coalesce("is_seed", F.lit(False))
    frontier = waiting.select("url", seed.alias("is_seed"), F.coalesce("depth", F.lit(0)).alias("depth"), F.when(seed, 0).otherwise(1).alias("priority"))
    return {"frontier": frontier, "visited": _normal(visited), "known": _normal(known.select("url").unionByName(starting.select("url")))}


def publications(pages: DataFrame, order: list[str], every: int = EVERY) -> DataFrame:
    """version, pages, last and final of the publications of a crawl: one after every so many pages, and a final one at its end.

    ``last`` is the number of pages crawled by then. Pages are numbered over ranges
    of their order, so the crawl is never sorted in one task.
    """
    placed = running_total(pages.select(*order).withColumn("_g", F.lit(0)), ["_g"], [F.col(c).asc() for c in order], F.lit(1), "_n")
    counts = placed.groupBy(F.floor(F.col("_n") / every).cast("long").alias("version")).agg(F.count(F.lit(1)).alias("pages"))
    return counts.select((F.col("version") + 1).alias("version"), "pages", (F.col("version") * every + F.col("pages")).alias("last"), (F.col("pages") < every).alias("final"))


class Publisher:
    """Decides while a crawl runs whether to publish: after every so many pages, one publication at a time.

    ``publish`` is called with the count of pages; a call that comes while another
    publication runs is left out, and its pages count for the next.
    """

    def __init__(self, publish, every: int = EVERY):
        self.publish, self.every, self.saved, self.lock = publish, every, 0, threading.Lock()

    def offer(self, crawled: int, final: bool = False) -> bool:
        """Whether this call published; the final one does unless nothing was crawled."""
        if not crawled or (not final and crawled - self.saved < self.every) or not self.lock.acquire(blocking=final):
            return False
        try:
            self.publish(crawled)
            self.saved = crawled
            return True
        finally:
            self.lock.release()


def rescored(documents: DataFrame, pages: DataFrame, graph: DataFrame, owners: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, url and the scores that a publication gives each document (doc_id, url).

    Authority is PageRank over the link graph (src, dst), 0 outside it. Content
    quality sees the stored text alone, without markup, keywords and age, and takes
    any owner of a fingerprint for a copy. Link quality is that of the graph's own
    links, with the anchors it gives them.
    """
    edges = G.edges(graph)
    ranks = G.pagerank(edges) if rounds is None else G.pagerank(edges, max_iterations=rounds, fixed=True)
    plain = pages.select(
        "doc_id", "content_text", "word_count", "content_fingerprint", F.lit(None).cast("string").alias("html_text"), F.lit(None).cast("array<string>").alias("keywords"), F.lit(None).cast("int").alias("days_old")
    )
    content = Q.content_quality(plain, owners, snapshot_compat=True).select("doc_id", F.col("overall").alias("panda_score"))
    counted = edges.groupBy(F.col("dst").alias("target_url")).agg(F.count(F.lit(1)).alias("inbound"))
    targets = documents.select(F.col("url").alias("target_url")).distinct().join(counted, "target_url", "left")
    quality = L.link_quality(L.graph_anchors(edges), targets).select(F.col("target_url").alias("url"), F.col("overall").alias("penguin_score"))
    joined = documents.select("doc_id", "url").distinct().join(ranks.select(F.col("node").alias("url"), "pagerank"), "url", "left").join(content, "doc_id", "left").join(quality, "url", "left")
    return joined.select("doc_id", "url", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.coalesce("panda_score", F.lit(0.5)).alias("panda_score"), F.coalesce("penguin_score", F.lit(0.5)).alias("penguin_score"))


def effective_state(requested: Column, searchable: Column) -> Column:
    """What is shown of a crawler's state: with an index to search, indexing is refreshing, and stopped is ready."""
    asked = F.coalesce(requested, F.lit("indexing"))
    return F.when(searchable & (asked == "indexing"), "refreshing").when(searchable & (asked == "stopped"), "ready").otherwise(asked)


def status(events: DataFrame, order: list[str], searchable: Column, fields: list[str]) -> DataFrame:
    """One row: the state that the last event makes, and of each field the last value that any event gave."""
    at = F.struct(*order)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields]
    return events.agg(F.max_by(effective_state(F.col("state"), searchable), at).alias("status"), *last)


def accepted(events: DataFrame, order: list[str], most: int = WAITING) -> DataFrame:
    """The events between two sendings that find room among those waiting: the first ``most``; later ones are turned away."""
    placed = running_total(events.withColumn("_g", F.lit(0)), ["_g"], [F.col(c).asc() for c in order], F.lit(1), "_ahead")
    return placed.filter(F.col("_ahead") < most).drop("_g", "_ahead")


def first_places(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


# What fails in a demonstration.
REASONS = ("timeout", "403 Forbidden", "404 Not Found", "Connection Error")


def demo_events(spark: SparkSession, pages: int, seed: int = 0) -> DataFrame:
    """Events of an invented crawl: nine pages of ten are crawled and find 5 to 20 links, the others fail.

    Chance is a hash of the page's number, so every run is alike and rows are made in parallel.
    """
    chance = lambda what: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.lit(what), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    n = spark.range(pages)
    url = F.concat(F.lit("https://site"), (chance("site") % 20).cast("string"), F.lit(".example/page/"), F.col("id").cast("string"))
    crawled = chance("fate") % 10 < 9
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (chance("reason") % len(REASONS) + 1).cast("int"))
    return n.select("id", F.when(crawled, "crawled").otherwise("failed").alias("type"), url.alias("url"), (chance("depth") % 4).cast("int").alias("depth"), F.when(crawled, (chance("links") % 16 + 5).cast("int")).otherwise(0).alias("links_found"), F.when(~crawled, reason).alias("reason"))
