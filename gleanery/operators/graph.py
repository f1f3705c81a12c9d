"""Link graphs: edges, nodes, degrees, PageRank, reachability."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.numbers import rounded
from gleanery.operators.scale import cut, join_counted


def edges(links: DataFrame) -> DataFrame:
    """Distinct src and dst."""
    return links.select("src", "dst").filter("src is not null and dst is not null").distinct()


def nodes(graph: DataFrame) -> DataFrame:
    """Every node that has or receives a link."""
    return graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()


def dangling(graph: DataFrame) -> DataFrame:
    """Nodes without outgoing links."""
    return nodes(graph).join(graph.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def degrees(graph: DataFrame) -> DataFrame:
    """node, in_degree and out_degree."""
    ends = graph.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(graph.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(graph: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, fixed: bool = False) -> DataFrame:
    """node and pagerank (6 decimals) of distinct edges.

    Dangling nodes spread their rank over all nodes. When the ranks change by
    less than the tolerance in total, those before the change are returned;
    ``fixed`` runs all iterations instead. Each round is one join by source, in which
    a source with many links is no hot key (its links are known by its degree),
    one partial aggregation by target, and one write.
    """
    graph = cut(edges(graph))
    every = cut(nodes(graph).join(graph.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")), "node", "left"))
    n, links = every.count(), graph.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("pagerank"))
    ranks = every.withColumn("p", F.lit(1.0 / n))
    lost = ranks.filter("degree is null").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("s")).first().s
    # the ranks of the last two rounds are kept: one of them is the result
    older = last = None
    for _ in range(max_iterations):
        shares = ranks.filter("degree is not null").select(F.col("node").alias("src"), (F.col("p") / F.col("degree")).alias("share"), "degree")
        received = join_counted(graph, shares, ["src"], "degree", links).groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("r"))
        fresh = cut(ranks.join(received, "node", "left").select("node", "degree", F.col("p").alias("before"), (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("r", F.lit(0.0))).alias("p")), replaces=older)
        older, last = last, fresh
        state = fresh.agg(F.sum(F.abs(F.col("p") - F.col("before"))).alias("change"), F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("p"))), F.lit(0.0)).alias("lost")).first()
        if not fixed and state.change < tolerance:
            break
        ranks, lost = fresh.select("node", "degree", "p"), state.lost
    return ranks.select("node", rounded(F.col("p"), 6).alias("pagerank"))


def reachable(graph: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and depth of the nodes that links lead to from the seeds (column node), within ``max_depth`` links if given."""
    found = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = found
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = graph.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        front = cut(step)
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
