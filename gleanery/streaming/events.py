"""Crawl events as streams: counts, windows with late data, and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fields of the five kinds of crawl events.
CRAWL_EVENT = "type string, url string, from_url string, depth int, title string, links_found int, reason string, queue array<string>, status string, message string, at timestamp"
QUEUE_SHOWN = 20


def counts(events: DataFrame, by: str = "type") -> DataFrame:
    """Events of each kind; works on tables and streams."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def shown(events: DataFrame) -> DataFrame:
    """Events with the queue cut to what is shown."""
    return events.withColumn("queue", F.slice("queue", 1, QUEUE_SHOWN))


def windowed(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "20 days") -> DataFrame:
    """Events of each kind in event-time windows; later ones than the watermark are dropped in a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def open_circuits(events: DataFrame, failed: Column, run: int = 3, cooldown: int = 900) -> DataFrame:
    """Openings of the circuit of each origin in a stream of (origin, at, order, failed) events.

    The state of an origin is its count of failures in a row; a success clears
    it, and it goes when the stream ends. Events of a batch are taken in order.
    """
    schema = "origin string, opened_at timestamp, until timestamp, failures long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "order"]).itertuples(index=False):
            streak = streak + 1 if row.failed else 0
            if streak and streak % run == 0:
                out.append((key[0], row.at, row.at + pd.Timedelta(seconds=cooldown), streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["origin", "opened_at", "until", "failures"])

    flagged = events.select("origin", "at", "order", failed.alias("failed"))
    return flagged.groupBy("origin").applyInPandasWithState(step, schema, "streak long", "append", GroupStateTimeout.NoTimeout)
