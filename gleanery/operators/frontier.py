"""Crawl frontier: admission, order, caps, refill, maintenance, and a batch simulation."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import url as U
from gleanery.operators.scale import cut, free


@dataclass(frozen=True)
class FrontierRules:
    """Depths, caps and URL rules of a crawl."""

    seed_depth: int = 20
    max_depth: int = 6
    pages_per_domain: int = 200
    urls: U.UrlRules = field(default_factory=U.UrlRules)


def admitted(candidates: DataFrame, visited: DataFrame, known: DataFrame, counts: DataFrame, rules: FrontierRules = FrontierRules()) -> DataFrame:
    """url, is_seed, depth and priority of the candidates (url, is_seed, depth) that enter the frontier.

    URLs are normalised; skipped, too deep, visited and already known ones stay
    out, known seeds of depth 0 excepted; other domains than seeds' are capped by
    ``counts`` (domain, pages). Of several candidates of a URL the first by priority, depth enters.
    """
    c = candidates.select(U.present(U.normalized(F.col("url"))).alias("url"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"), "depth")
    limit = F.when(F.col("is_seed"), rules.seed_depth).otherwise(rules.max_depth)
    c = c.filter(~U.skipped(F.col("url"), rules.urls) & (F.col("depth") <= limit))
    c = c.withColumn("priority", F.when(F.col("is_seed"), 0).otherwise(1))
    first = c.groupBy("url").agg(F.min(F.struct("priority", "depth", "is_seed")).alias("_b")).select("url", "_b.is_seed", "_b.depth", "_b.priority")
    fresh = first.join(visited.select("url").distinct(), "url", "left_anti").join(known.select("url", F.lit(True).alias("_known")).distinct(), "url", "left")
    fresh = fresh.filter(F.col("_known").isNull() | (F.col("is_seed") & (F.col("depth") == 0))).drop("_known").withColumn("domain", U.netloc(F.col("url")))
    capped = fresh.join(counts.select("domain", "pages"), "domain", "left").filter(F.col("is_seed") | (F.coalesce("pages", F.lit(0)) < rules.pages_per_domain))
    return capped.select("url", "is_seed", "depth", "priority")


def order(frontier: DataFrame, batch: int) -> DataFrame:
    """The next URLs: seeds first, then the shallow, then by URL."""
    return frontier.orderBy("priority", "depth", "url").limit(batch)


def capped_by_domain(frontier: DataFrame, counts: DataFrame, cap: int) -> DataFrame:
    """The URLs of the frontier that the cap leaves, in crawl order within each domain.

    Only the first ``cap`` of each domain can stay, so each task keeps its own
    first ``cap`` of a domain and those meet for the final cut: no domain's
    whole frontier is sorted in one place.
    """
    keyed = frontier.withColumn("domain", U.netloc(F.col("url"))).withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(64)))
    local = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("domain", "_salt").orderBy("priority", "depth", "url"))).filter(F.col("_n") <= cap)
    whole = local.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("priority", "depth", "url")))
    return whole.join(counts.select("domain", "pages"), "domain", "left").filter(F.col("_n") + F.coalesce("pages", F.lit(0)) <= cap).select("url", "is_seed", "depth", "priority")


def requeued(candidates: DataFrame, visited: DataFrame, counts: DataFrame, rules: FrontierRules = FrontierRules()) -> DataFrame:
    """As ``admitted``, but known URLs may return, and the cap applies to seeds too."""
    nothing = candidates.select("url").limit(0)
    open_domains = admitted(candidates, visited, nothing, counts, rules).withColumn("domain", U.netloc(F.col("url"))).join(counts.select("domain", "pages"), "domain", "left")
    return open_domains.filter(F.coalesce("pages", F.lit(0)) < rules.pages_per_domain).select("url", "is_seed", "depth", "priority")


def children(links: DataFrame, parents: DataFrame) -> DataFrame:
    """Candidates one deeper than the pages (url, depth) that link to them; never seeds."""
    return links.join(parents.select(F.col("url").alias("src"), "depth"), "src").select(F.col("dst").alias("url"), F.lit(False).alias("is_seed"), (F.col("depth") + 1).alias("depth"))


def refilled(queue_size: int, idle_seconds: float, seeds: DataFrame, sources: DataFrame, visited: DataFrame, idle_delay: float = 20.0, continuous: bool = True, look: int = 200, most: int = 100) -> DataFrame:
    """Candidates that refill a frontier running dry: unvisited seeds, and unvisited ones of the first sources by URL.

    Only in continuous mode; not above 10 waiting URLs, and with 1 to 10 of them only after the idle delay.
    """
    idle_delay = max(5.0, idle_delay)
    wanted = continuous and (queue_size == 0 or (queue_size <= 10 and idle_seconds >= idle_delay))
    own = seeds.select("url", F.lit(True).alias("is_seed"), F.lit(0).alias("depth"))
    linked = sources.select("url").distinct().orderBy("url").limit(look).join(visited.select("url"), "url", "left_anti").orderBy("url").limit(most)
    both = own.join(visited.select("url"), "url", "left_anti").unionByName(linked.select("url", F.lit(False).alias("is_seed"), F.lit(1).alias("depth")))
    return both if wanted else both.limit(0)


def new_seeds(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Seed URLs added since the last run, and those removed, with ``change``."""
    a, b = current.select("url").distinct(), saved.select("url").distinct()
    return a.join(b, "url", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "url", "left_anti").withColumn("change", F.lit("removed")))


def reset_seeds(state: DataFrame, seeds: DataFrame) -> DataFrame:
    """The visited or known URLs without the seeds, compared in their simple normal form."""
    own = seeds.select(U.normalized_simple(F.col("url")).alias("_n")).distinct()
    return state.withColumn("_n", U.normalized_simple(F.col("url"))).join(own, "_n", "left_anti").drop("_n")


def recovered_counters(documents: DataFrame) -> DataFrame:
    """Counters of a clean state rebuilt from the documents."""
    n = F.count_distinct("doc_id")
    return documents.agg(n.alias("docs_indexed"), n.alias("crawl_count"), n.alias("last_saved_count"), (F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).alias("next_doc_id"))


def crawl(links: DataFrame, seeds: DataFrame, rules: FrontierRules = FrontierRules(), limit: int = 0, rounds: int | None = None, batch: int = 10_000) -> DataFrame:
    """url, depth and round of the pages a crawl of a recorded link graph (src, dst) would visit.

    A round takes the next batch, counts its domains, and admits the batch's
    children; the crawl ends when nothing waits, at its limit, or after ``rounds`` if given.
    """
    visited = seeds.select("url", F.lit(0).alias("depth"), F.lit(0).alias("round")).limit(0)
    counts = seeds.select(F.lit("").alias("domain"), F.lit(0).alias("pages")).limit(0)
    frontier = admitted(seeds.select("url", F.lit(True).alias("is_seed"), F.lit(0).alias("depth")), visited, visited, counts, rules)
    frontier, done = cut(frontier), 0
    for step in count(1) if rounds is None else range(1, rounds + 1):
        size = batch if not limit else min(batch, limit - done)
        if size <= 0:
            break
        taken = cut(order(capped_by_domain(frontier, counts, rules.pages_per_domain), size))
        n = taken.count()
        if not n:
            break
        done += n
        visited = cut(visited.unionByName(taken.select("url", "depth", F.lit(step).alias("round"))))
        counts = cut(visited.groupBy(U.netloc(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).cast("int").alias("pages")))
        rest = frontier.join(taken.select("url"), "url", "left_anti")
        fresh = admitted(children(links, taken), visited, frontier, counts, rules)
        older = [visited_before, counts_before, frontier] if step > 1 else []
        frontier = cut(rest.unionByName(fresh.select(*rest.columns)))
        for table in older:
            free(table)
        visited_before, counts_before = visited, counts
    return visited
