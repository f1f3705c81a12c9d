"""Link quality: domains, anchors, link profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.numbers import rounded
from gleanery.functions.quality import SPACE, words

# Domains of the highest standing.
HIGH_AUTHORITY = (
    "wikipedia.org", "github.com", "stackoverflow.com", "reddit.com", "medium.com", "dev.to", "bbc.com", "cnn.com", "nytimes.com", "guardian.com", "reuters.com", "apnews.com", "aljazeera.com", "npr.org", "themaven.net", "blogspot.com", "substack.com", "npmjs.com", "pypi.org", "docker.com",
    "aws.amazon.com", "google.com", "microsoft.com", "apple.com", "mozilla.org", "linkedin.com", "youtube.com", "twitter.com", "facebook.com", "britannica.com", "coursera.org", "udemy.com", "edx.org", "allrecipes.com", "foodnetwork.com", "bonappetitmag.com", "quora.com", "discourse.com", "hashnode.com", "dev.community",
)
# Worth of a top-level domain.
TOP_LEVEL = ((".edu", 0.85), (".gov", 0.85), (".org", 0.7), (".com", 0.6))
# Anchors that say nothing of their target.
GENERIC_ANCHORS = ("click here", "link", "here", "more", "read more", "more info", "continue", "go", "visit", "page", "site", "click", "a", "the", "and")
# Weights of the components.
WEIGHTS = {"backlink": 0.25, "authority": 0.35, "anchor": 0.20, "farm": 0.20}


def domain_authority(domain: Column, known: Column | None = None) -> Column:
    """Standing of a domain; ``known`` is a looked-up value that takes precedence."""
    low = F.lower(F.coalesce(domain, F.lit("")))
    bare = F.replace(low, F.lit("www."), F.lit(""))
    guess = F.when(bare.isin(*HIGH_AUTHORITY), 0.9)
    for suffix, worth in TOP_LEVEL:
        guess = guess.when(bare.endswith(suffix), worth)
    guess = guess.otherwise(0.4)
    if known is not None:
        guess = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), known)), guess)
    return F.when(low == "", 0.2).otherwise(guess)


def anchor(text: Column) -> dict[str, Column]:
    """text_length, is_generic, is_stuffed and naturalness of an anchor text; null counts as empty."""
    raw = F.coalesce(text, F.lit(""))
    clean = F.lower(F.regexp_replace(raw, f"^{SPACE}+|{SPACE}+$", ""))
    n = F.size(words(clean))
    generic = clean.isin(*GENERIC_ANCHORS)
    capitals = F.length(F.regexp_replace(raw, r"\P{Lu}", ""))
    marks = F.length(F.regexp_replace(raw, "[^!*]", ""))
    stuffed = (capitals > n * 0.5) | (marks > 2)
    worth = F.when(generic, 0.4).when(stuffed, 0.2).when(n > 10, 0.8).when(n > 3, 0.7).otherwise(0.6)
    empty = raw == ""
    return {
        "text_length": F.when(empty, 0).otherwise(n).cast("int"),
        "is_generic": F.when(empty, True).otherwise(generic),
        "is_stuffed": F.when(empty, False).otherwise(stuffed),
        "naturalness": F.when(empty, 0.3).otherwise(worth),
    }


def graph_anchors(graph: DataFrame, generic: bool = False) -> DataFrame:
    """Backlinks (target_url, domain, anchor_text, is_generic_anchor) of a link graph (src, dst) whose anchors were not kept."""
    host = F.regexp_extract("src", r"^[^:/?#]+://([^/?#]*)", 1)
    return graph.select(F.col("dst").alias("target_url"), F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown")).alias("domain"), F.concat(F.lit("link from "), host).alias("anchor_text"), F.lit(generic).alias("is_generic_anchor"))


def backlink_score(inbound: Column) -> Column:
    """0 without links, growing with their logarithm up to 1."""
    n = F.coalesce(inbound, F.lit(0)).cast("double")
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), 0.1 + F.log(n + 1) / 6))


def farm_profile(backlinks: DataFrame, target: str = "target_url") -> DataFrame:
    """One row a target: link count, distinct domains, concentration, repetition, generic share, farm score and suspicion.

    Counts per (target, anchor) and (target, domain) are pre-aggregated, so a
    target with very many links is no hot key: what meets is one row for each of
    its distinct anchors and domains.
    """
    per_anchor = (
        backlinks.withColumn("_anchor", F.lower(F.trim(F.coalesce("anchor_text", F.lit("")))))
        .groupBy(target, "_anchor")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(F.col("is_generic_anchor").cast("int"), F.lit(0))).alias("_g"))
    )
    anchors = per_anchor.groupBy(target).agg(F.sum("_n").alias("links"), F.sum("_g").alias("generic"), F.coalesce(F.max(F.when(F.col("_anchor") != "", F.col("_n"))), F.lit(0)).alias("most_repeated"))
    domains = per_domain(backlinks, target).groupBy(target).agg(F.count(F.lit(1)).alias("domains"))
    profile = anchors.join(domains, target)
    n = F.col("links")
    concentration, repetition, share = 1 - F.col("domains") / n, F.col("most_repeated") / n, F.col("generic") / n
    points = F.when(concentration > 0.7, 0.4).otherwise(0.0) + F.when(repetition > 0.3, 0.4).otherwise(0.0) + F.when((share > 0.5) & (n > 10), 0.2).otherwise(0.0)
    few = n < 3
    return profile.select(
        target, "links", "domains",
        F.when(few, 0.0).otherwise(concentration).alias("concentration"), F.when(few, 0.0).otherwise(repetition).alias("repetition"), F.when(few, 0.0).otherwise(share).alias("generic_share"),
        F.when(few, 0.0).otherwise(points).alias("farm_score"), F.when(few, False).otherwise(points > 0.5).alias("suspicious"),
    )


def per_domain(backlinks: DataFrame, target: str = "target_url") -> DataFrame:
    """Links of each domain to each target; a null domain counts as ''."""
    return backlinks.withColumn("domain", F.coalesce("domain", F.lit(""))).groupBy(target, "domain").agg(F.count(F.lit(1)).alias("n"))


def link_quality(backlinks: DataFrame, inbound: DataFrame, target: str = "target_url", generic_default: bool | None = None) -> DataFrame:
    """One row for each target of ``inbound`` (target, inbound): component scores and their weighted sum.

    Authority weighs each domain by the square of its links, over the number of
    links, so it may exceed 1. Targets without links have authority 0, anchors 0.5
    and no farm.
    """
    if generic_default is not None:
        backlinks = backlinks.withColumn("is_generic_anchor", F.lit(generic_default))
    authority = per_domain(backlinks, target).groupBy(target).agg((F.sum(F.round(domain_authority(F.col("domain")) * 1000).cast("long") * F.col("n") * F.col("n")) / 1000 / F.sum("n")).alias("authority"))
    anchors = backlinks.groupBy(target).agg((F.sum(F.round(anchor(F.col("anchor_text"))["naturalness"] * 10).cast("long")) / 10 / F.count(F.lit(1))).alias("anchor"))
    joined = inbound.join(authority, target, "left").join(anchors, target, "left").join(farm_profile(backlinks, target), target, "left")
    farm = F.coalesce("farm_score", F.lit(0.0))
    parts = {
        "backlink": backlink_score(F.col("inbound")),
        "authority": F.coalesce("authority", F.lit(0.0)),
        "anchor": F.coalesce("anchor", F.lit(0.5)),
        "farm": F.when(F.coalesce("suspicious", F.lit(False)), F.greatest(F.lit(0.0), 0.5 - farm)).otherwise(1 - farm),
    }
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return joined.select(target, *[rounded(v).alias(f"{k}_score") for k, v in parts.items()], rounded(total).alias("overall"), F.coalesce("suspicious", F.lit(False)).alias("suspicious"), F.coalesce("domains", F.lit(0)).cast("long").alias("domains"))
