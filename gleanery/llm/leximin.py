"""One order of items from several scores by leximin.

Each score becomes a percentile among the items of its group, so neither range
nor shape of a score matters. An item's percentiles are sorted ascending, and
items are compared by these arrays: first by their weakest score, then by the
second weakest and so on, so that a strong score can't mask a weak one.

Percentiles are mid-ranks: the share of the group's values below, plus half the
share equal. They come from counts of distinct values, and both these and the
final ranks are running totals over range-partitioned rows, so a group with a
third of all items is spread over all tasks.

Defined cases: a null, NaN or infinite score is a missing measurement and takes
the middle percentile; ties in all scores are ordered by doc_id; repeated rows of an
item are one item with the largest of each score; a null group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import cut, join_counted, running_total

MISSING = 0.5


def usable(score: Column) -> Column:
    """The score, null where it is not a finite number."""
    x = score.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def percentiles(items: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """``group``, doc_id, metric and pct of every present score."""
    metrics = F.array(*[F.struct(F.lit(i).alias("metric"), usable(F.col(s)).alias("value")) for i, s in enumerate(scores)])
    long = cut(items.select(group, "doc_id", F.explode(metrics).alias("_m")).select(group, "doc_id", "_m.metric", "_m.value").filter("value is not null"))
    values = long.groupBy(group, "metric", "value").agg(F.count(F.lit(1)).alias("equal"))
    below = cut(running_total(values, [group, "metric"], [F.col("value")], F.col("equal"), "below"))
    sizes = cut(long.groupBy(group, "metric").agg(F.count(F.lit(1)).alias("n")))
    total = long.count()
    pct = join_counted(below, below.groupBy(group, "metric").agg(F.count(F.lit(1)).alias("_rows")).join(sizes, [group, "metric"]), [group, "metric"], "_rows", max(below.count(), 1))
    ready = cut(pct.select(group, "metric", "value", "equal", ((F.col("below") + F.col("equal") / 2) / F.col("n")).alias("pct")))
    return join_counted(long, ready, [group, "metric", "value"], "equal", total).select(group, "doc_id", "metric", "pct")


def leximin_order(items: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """``group``, doc_id, the ascending vector of percentiles and position from 1 of every item."""
    key = F.coalesce(F.col(group), F.lit("\u0000"))
    once = cut(items.filter("doc_id is not null").withColumn("_g", key).groupBy("_g", "doc_id").agg(*[F.max(usable(F.col(s))).alias(s) for s in scores]))
    pct = percentiles(once.withColumnRenamed("_g", "grp"), "grp", scores)
    vectors = pct.groupBy("grp", "doc_id").agg(F.collect_list("pct").alias("_v"))
    filled = once.withColumnRenamed("_g", "grp").select("grp", "doc_id").join(vectors, ["grp", "doc_id"], "left").withColumn("_v", F.coalesce("_v", F.array().cast("array<double>")))
    missing = F.array_repeat(F.lit(MISSING), len(scores) - F.size("_v"))
    ready = cut(filled.select("grp", "doc_id", F.array_sort(F.concat("_v", missing)).alias("vector")))
    ranked = running_total(ready, ["grp"], [F.col("vector").desc(), F.col("doc_id").asc()], F.lit(1), "_before")
    return ranked.select(F.when(F.col("grp") != "\u0000", F.col("grp")).alias(group), "doc_id", "vector", (F.col("_before") + 1).cast("long").alias("position"))
