"""Health of endpoints and origins from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import running_total

# What messages tell, in order of precedence.
OUTCOMES = (
    ("success", ("initialization sequence completed",)),
    ("permission_error", ("cannot ioctl tunsetiff", "operation not permitted")),
    ("auth_failed", ("authentication failed", "auth_failed")),
    ("missing_support_files", ("missing support files",)),
    ("missing_auth", ("needs auth",)),
    ("resolve_failed", ("host resolution failed",)),
    ("no_route", ("no route to host",)),
    ("tun_error", ("cannot open tun",)),
    ("connection_refused", ("connection refused",)),
    ("connection_timeout", ("connection timed out",)),
    ("tls_error", ("tls key negotiation failed", "tls handshake failed")),
    ("fatal_error", ("fatal openvpn error", "options error")),
)
UNKNOWN = "unknown_failure"
# What the last outcome adds to a health score.
BONUS = {
    "success": 400, "permission_error": -260, "unknown_failure": -140, "connection_timeout": -220, "connection_refused": -220, "resolve_failed": -220,
    "tls_error": -280, "auth_failed": -280, "fatal_error": -280, "missing_support_files": -280, "missing_auth": -280, "no_route": -280,
}


def outcome(message: Column) -> Column:
    """Label of a message by the first rule that applies, ``unknown_failure`` else."""
    low = F.lower(F.coalesce(message, F.lit("")))
    label = None
    for name, words in OUTCOMES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(UNKNOWN)


def rollup(events: DataFrame, key: str, failed: Column, at: str, last: str) -> DataFrame:
    """key, success_count, failure_count, last_outcome and last_checked_at, by partial aggregation."""
    return events.groupBy(key).agg(
        F.count_if(~failed).alias("success_count"), F.count_if(failed).alias("failure_count"), F.max_by(last, F.struct(at, last)).alias("last_outcome"), F.max(at).alias("last_checked_at")
    )


def score(success: Column, failure: Column, last: Column) -> Column:
    """Additive health: successes count more than failures, and the last outcome counts by its kind."""
    bonus = F.lit(0)
    for name, worth in BONUS.items():
        bonus = F.when(last == name, worth).otherwise(bonus)
    return success * 120 - failure * 20 + bonus


def _runs(events: DataFrame, key: str, at: str, order: str, failed: Column) -> DataFrame:
    """Events with ``_f`` (1 for a failure) and ``_run``, the successes of the key so far: constant within a run of failures."""
    flagged = events.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int"))
    before = running_total(flagged, [key], [F.col(at), F.col(order)], 1 - F.col("_f"), "_s")
    return before.withColumn("_run", F.col("_s") + 1 - F.col("_f")).drop("_s")


def breaker(events: DataFrame, key: str, at: str, order: str, failed: Column, run: int = 3, cooldown: int = 900) -> DataFrame:
    """key, opened_at, until and failures of every opening of a circuit: ``run`` failures in a row.

    Runs are gaps and islands over running totals, so no key's events meet in one
    task. A run opens the circuit at its ``run``-th failure and every ``run``
    failures on. (``at``, ``order``) must be unique within a key.
    """
    failures = _runs(events, key, at, order, failed).filter("_f = 1")
    placed = running_total(failures, [key, "_run"], [F.col(at), F.col(order)], F.lit(1), "_before").withColumn("_k", F.col("_before") + 1)
    opened = placed.filter(F.col("_k") % run == 0)
    return opened.select(key, F.col(at).alias("opened_at"), (F.col(at) + F.expr(f"interval {cooldown} seconds")).alias("until"), F.col("_k").cast("long").alias("failures"))


def politeness(events: DataFrame, key: str, at: str, order: str, failed: Column, robots_delay: Column, low: float = 1.0, high: float = 2.0, most: float = 30.0) -> DataFrame:
    """Seconds to wait after each event: the robots delay or the mean of the range, more after failures in a row."""
    runs = _runs(events, key, at, order, failed)
    streak = running_total(runs, [key, "_run"], [F.col(at), F.col(order)], F.col("_f"), "_before").withColumn("failures", F.col("_before") + F.col("_f"))
    base = F.when(robots_delay.isNotNull(), F.greatest(robots_delay, F.lit(low))).otherwise((low + high) / 2)
    wait = F.when(F.col("failures") > 0, F.least(F.lit(most), base + 2.0 * F.col("failures"))).otherwise(base)
    return streak.select(*events.columns, F.col("failures").cast("long").alias("failures"), wait.alias("delay"))
