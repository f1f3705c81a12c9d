"""At most so many records for each contributor, the best by score.

The cutoff of each contributor over its limit is found by parallel bisection:
lower and upper bounds of all contributors are refined together, one pass over
the records a round, in which the records above each of ``STEPS`` midpoints of
each contributor are counted. Pre-aggregated counts are all that is shuffled, so
a contributor with a third of all records costs no more than any other. When an
interval holds a single score, that is the cutoff, and the records tied at it
are cut at an identifier found by the same bisection.

No record is sorted or collected by contributor. Contributors over a share
limit are fewer than ``1 / share``; they are broadcast when that bound holds, and
joined by key when the limit is a plain number.

Defined cases: a null score counts as ``DEFAULT_SCORE``, NaN as
well, infinite ones as 1e300 and -1e300; a null contributor is a contributor; records without an
identifier are left out; repeated rows count once; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import cut

DEFAULT_SCORE = 0.5
#: Parts that a round splits each interval into.
STEPS = 16
#: Contributors that may be broadcast; beyond it they are joined by key.
BROADCAST_ROWS = 10_000


def _bisect(rows: DataFrame, bounds: DataFrame, value: str, few: bool) -> DataFrame:
    """contributor, cutoff, room and ties: the value at which the running count from the top reaches ``room``.

    The room returned is what is left of it for the ``ties`` rows at the cutoff.

    ``rows`` has contributor and ``value`` (double); ``bounds`` has contributor,
    low, high (closed interval) and room (rows still to keep from the top of it, at
    least 1 and fewer than there are).
    """
    side = F.broadcast if few else (lambda x: x)
    bounds = cut(bounds)
    done = None
    while True:
        width = (F.col("high") - F.col("low")) / STEPS
        step = F.least(F.floor((F.col(value) - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(STEPS - 1))
        slot = F.when(F.col(value) == F.col("high"), F.lit(STEPS - 1)).otherwise(F.coalesce(step, F.lit(0)))
        inside = rows.join(side(bounds), "contributor").filter(F.col(value).between(F.col("low"), F.col("high")))
        counts = inside.groupBy("contributor", slot.cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
        # at most STEPS rows a contributor from here on
        tops = F.array_sort(F.collect_list(F.struct((-F.col("slot")).alias("k"), "n", "least", "most")))
        steps = counts.groupBy("contributor").agg(tops.alias("tops")).join(bounds.select("contributor", "room"), "contributor")
        begin = F.struct(F.lit(0).cast("long").alias("over"), F.lit(None).cast("struct<k:long,n:long,least:double,most:double>").alias("hit"))
        walked = F.aggregate(
            "tops",
            begin,
            lambda acc, x: F.when(acc["hit"].isNotNull(), acc)
            .when(acc["over"] + x["n"] >= F.col("room"), F.struct(acc["over"].alias("over"), x.alias("hit")))
            .otherwise(F.struct((acc["over"] + x["n"]).alias("over"), acc["hit"].alias("hit"))),
        )
        state = steps.withColumn("_w", walked).select(
            "contributor", F.col("_w.hit.least").alias("low"), F.col("_w.hit.most").alias("high"), (F.col("room") - F.col("_w.over")).alias("room"), F.col("_w.hit.n").alias("ties")
        )
        state = cut(state)
        settled = state.filter("low = high").select("contributor", F.col("low").alias("cutoff"), "room", "ties")
        done = settled if done is None else done.unionByName(settled)
        bounds = state.filter("low < high").drop("ties")
        if bounds.isEmpty():
            return done


def over_limit(records: DataFrame, contributor: str, share: float | None = None, most: int | None = None) -> DataFrame:
    """doc_id of the records beyond the limit of their contributor.

    The limit is ``share`` of all records, rounded down but at least 1, or ``most``
    records. ``records`` has doc_id, score and the contributor column; the best
    scores stay, and of equal scores the smaller doc_id.
    """
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(DEFAULT_SCORE)), F.lit(DEFAULT_SCORE))
    score = F.greatest(F.least(score, F.lit(1e300)), F.lit(-1e300))
    once = records.filter("doc_id is not null").groupBy("doc_id").agg(F.first(F.struct(F.col(contributor).alias("contributor"), score.alias("score"))).alias("_r"))
    rows = cut(once.select("doc_id", F.coalesce("_r.contributor", F.lit("")).alias("contributor"), (F.col("_r.score") + F.lit(0.0)).alias("score")))
    sizes = rows.groupBy("contributor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    total = rows.count()
    limit = most if most is not None else max(1, int(total * share + 1e-9))
    large = cut(sizes.filter(F.col("n") > limit))
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda x: x)
    concerned = rows.join(side(large.select("contributor")), "contributor")
    cutoffs = cut(_bisect(concerned, large.select("contributor", "low", "high", F.lit(limit).cast("long").alias("room")), "score", few))
    marked = concerned.join(side(cutoffs), "contributor")
    below = marked.filter(F.col("score") < F.col("cutoff")).select("doc_id")
    # ties at the cutoff: the smaller identifiers stay, so identifiers are bisected from the bottom
    tied = marked.filter((F.col("score") == F.col("cutoff")) & (F.col("room") < F.col("ties"))).select("contributor", "doc_id", "room")
    parts = _bisect_ids(cut(tied), few)
    return below.unionByName(parts)


def _bisect_ids(tied: DataFrame, few: bool) -> DataFrame:
    """doc_id of the tied records beyond the ``room`` smallest identifiers, which are split in halves as integers."""
    side = F.broadcast if few else (lambda x: x)
    bounds = tied.groupBy("contributor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("room").alias("room"))
    bounds = cut(bounds)
    kept_to = None
    while not bounds.isEmpty():
        # every midpoint keeps the invariant: room identifiers of [low, high] stay, and high is in excess
        width = F.greatest(F.expr("(high - low) div " + str(STEPS)), F.lit(1))
        rows = tied.drop("room").join(side(bounds), "contributor").filter("doc_id between low and high").withColumn("slot", F.expr("(doc_id - low)") / width)
        counts = rows.groupBy("contributor", F.floor("slot").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        steps = counts.groupBy("contributor").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "least", "most"))).alias("_s")).join(bounds.select("contributor", "room"), "contributor")
        begin = F.struct(F.lit(0).cast("long").alias("under"), F.lit(None).cast("struct<slot:long,n:long,least:long,most:long>").alias("hit"))
        walked = F.aggregate(
            "_s",
            begin,
            lambda acc, x: F.when(acc["hit"].isNotNull(), acc)
            .when(acc["under"] + x["n"] >= F.col("room"), F.struct(acc["under"].alias("under"), x.alias("hit")))
            .otherwise(F.struct((acc["under"] + x["n"]).alias("under"), acc["hit"].alias("hit"))),
        )
        state = cut(
            steps.withColumn("_w", walked).select("contributor", F.col("_w.hit.least").alias("low"), F.col("_w.hit.most").alias("high"), (F.col("room") - F.col("_w.under")).alias("room"), F.col("_w.hit.n").alias("n"))
        )
        # a slot whose identifiers all stay ends at its largest, one of a single identifier at that
        settled = state.filter("n = room").select("contributor", F.col("high").alias("last"))
        kept_to = settled if kept_to is None else kept_to.unionByName(settled)
        bounds = state.filter("n > room").drop("n")
    if kept_to is None:
        return tied.select("doc_id")
    return tied.join(side(kept_to), "contributor").filter("doc_id > last").select("doc_id")
