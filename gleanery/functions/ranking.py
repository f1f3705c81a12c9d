"""Combined rank of search results from their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.numbers import clamp01, rounded

SIGNALS = ("pagerank", "panda_score", "penguin_score", "relevance_score")
# Weight of each signal by strategy, and what stands for a missing score.
STRATEGIES = {
    "balanced": (0.25, 0.35, 0.15, 0.25),
    "content_first": (0.15, 0.60, 0.10, 0.15),
    "relevance_first": (0.10, 0.25, 0.10, 0.55),
    "authority_first": (0.60, 0.15, 0.15, 0.10),
}
DEFAULTS = dict(zip(SIGNALS, (0.0, 0.5, 0.5, 0.0)))
#: Fixed value: the pagerank that counts as 1.
PAGERANK_CEILING = 0.1


def minmax(x: Column, low: float | Column, high: float | Column) -> Column:
    """``x`` from ``low``..``high`` to 0..1, 0.5 where the range is empty."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(low == high, 0.5).otherwise(clamp01((x - low) / F.nullif(high - low, F.lit(0.0))))


def filled(name: str) -> Column:
    """A signal with its default."""
    return F.coalesce(F.col(name).cast("double"), F.lit(DEFAULTS[name]))


def combined(strategy: str = "balanced") -> Column:
    """Weighted sum of the signals; unknown strategies count as balanced."""
    weights = STRATEGIES.get(strategy, STRATEGIES["balanced"])
    scaled = [minmax(filled(SIGNALS[0]), 0.0, PAGERANK_CEILING), *[clamp01(filled(s)) for s in SIGNALS[1:]]]
    return rounded(sum((s * w for s, w in zip(scaled, weights)), F.lit(0.0)), 6)


def threshold_factor() -> Column:
    """Factor for poor or excellent pages; the first that applies, from unclamped scores."""
    content, link = filled("panda_score"), filled("penguin_score")
    return F.when(content < 0.3, 0.3).when(link < 0.2, 0.5).when((content > 0.8) & (link > 0.8), 1.2).otherwise(1.0)


def rank_score(strategy: str = "balanced") -> Column:
    return rounded(combined(strategy) * threshold_factor(), 6)


def explanation(strategy: str = "relevance_first") -> Column:
    """One text line for each signal's share in the rank, and a grade of content, links and authority."""
    weights = STRATEGIES.get(strategy, STRATEGIES["balanced"])
    shares = [F.format_string(f"{name}: %.4f x {w:.0%} = %.4f".replace("%  ", "% ").replace(f"{w:.0%}", f"{w * 100:.0f}%%"), filled(name), filled(name) * w) for name, w in zip(SIGNALS, weights)]
    content, link, pagerank = filled("panda_score"), filled("penguin_score"), filled("pagerank")
    grades = [
        F.when(content > 0.8, "content: high").when(content > 0.6, "content: good").when(content > 0.4, "content: moderate").otherwise("content: low"),
        F.when(link > 0.8, "links: trusted").when(link > 0.5, "links: good").when(link > 0.3, "links: doubtful").otherwise("links: suspicious"),
        F.when(pagerank > 0.08, "popularity: high").when(pagerank > 0.04, "popularity: good").otherwise("popularity: average"),
    ]
    return F.concat_ws("\n", *shares, *grades)
