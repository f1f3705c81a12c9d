"""Circuit breakers by origin: which requests are skipped and when an origin is blocked.

The state of an origin depends on every event before, so an origin is read in
order; but a task reads its origins as a sorted stream and keeps one small state,
so memory does not grow with an origin's events. The same steps drive the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds of a block by what caused it, and failures in a row that cause it.
BLOCK = {"throttled": 900, "forbidden": 1800, "timeout": 600, "connection": 900}
AFTER = {"timeout": 5, "connection": 3}
_SECOND = 1_000_000
OPENED = "origin string, at timestamp, kind string, skipped boolean, failures long, blocked_until timestamp"


def step(state: tuple[int, int], kind: str, at: int) -> tuple[tuple[int, int], bool]:
    """State (failures in a row, blocked until, in microseconds) after an event, and whether the block kept it from happening.

    A block that has run out clears the failures. Success clears them. Throttled
    and forbidden requests block at once and count as connection failures too.
    """
    failures, until = state
    if until:
        if at < until:
            return state, True
        failures, until = 0, 0
    if kind in ("throttled", "forbidden"):
        failures, until = failures + 1, at + BLOCK[kind] * _SECOND
        if failures >= AFTER["connection"]:
            until = at + BLOCK["connection"] * _SECOND
    elif kind in AFTER:
        failures += 1
        if failures >= AFTER[kind]:
            until = at + BLOCK[kind] * _SECOND
    elif kind == "ok":
        failures = 0
    return (failures, until), False


def _run(rows, state):
    out = []
    for origin, at, kind in rows:
        state, skipped = step(state, kind, at.value // 1000)
        out.append((origin, at, kind, skipped, state[0], pd.Timestamp(state[1], unit="us") if state[1] else pd.NaT))
    return out, state


def circuits(events: DataFrame) -> DataFrame:
    """Events (origin, at, order, kind) with skipped, failures and blocked_until after each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        origin, state = None, (0, 0)
        for batch in batches:
            out = []
            for o, at, kind in zip(batch["origin"], batch["at"], batch["kind"]):
                if o != origin:
                    origin, state = o, (0, 0)
                rows, state = _run([(o, at, kind)], state)
                out += rows
            yield pd.DataFrame(out, columns=["origin", "at", "kind", "skipped", "failures", "blocked_until"])

    ordered = events.select("origin", "at", "order", "kind").filter("origin is not null and at is not null").repartition("origin").sortWithinPartitions("origin", "at", "order")
    return ordered.mapInPandas(read, OPENED)


def stream_circuits(events: DataFrame) -> DataFrame:
    """The same for a stream; a batch's events of an origin are taken in order."""

    def read(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = tuple(state.get) if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "order"])
        out, after = _run(zip(rows["origin"], rows["at"], rows["kind"]), before)
        state.update(after)
        yield pd.DataFrame(out, columns=["origin", "at", "kind", "skipped", "failures", "blocked_until"])

    flat = events.select("origin", "at", "order", "kind").filter("origin is not null and at is not null")
    return flat.groupBy("origin").applyInPandasWithState(read, OPENED, "failures long, until long", "append", GroupStateTimeout.NoTimeout)
