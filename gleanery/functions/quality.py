"""Content quality of a page: columns of its text, markup and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.numbers import clamp01, rounded

WINDOW, STEP = 100, 50
# Weights of the components.
WEIGHTS = {"length": 0.30, "structure": 0.20, "readability": 0.15, "keywords": 0.15, "originality": 0.15, "freshness": 0.05}
# Pattern and worth of each structural element; the list pattern is a character class.
ELEMENTS = {"h1": "(?i)<h1[^>]*>", "h2": "(?i)<h2[^>]*>", "h3": "(?i)<h[3-6][^>]*>", "paragraphs": "(?i)<p[^>]*>", "lists": "(?i)<[ul|ol][^>]*>", "blockquotes": "(?i)<blockquote[^>]*>"}
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def length_score(n: Column) -> Column:
    """Piecewise linear in the word count; it jumps at 100."""
    n = n.cast("double")
    score = (
        F.when(n < 100, n / 150 * 0.2)
        .when(n < 300, 0.2 + (n - 100) / 200 * 0.35)
        .when(n < 800, 0.55 + (n - 300) / 500 * 0.25)
        .when(n < 2000, 0.8 + (n - 800) / 1200 * 0.15)
        .otherwise(0.95 + F.least(n - 2000, F.lit(3000.0)) / 3000 * 0.05)
    )
    return clamp01(score)


def element_counts(markup: Column) -> dict[str, Column]:
    return {name: F.regexp_count(F.coalesce(markup, F.lit("")), F.lit(pattern)).cast("int") for name, pattern in ELEMENTS.items()}


def structure_score(counts: dict[str, Column]) -> Column:
    """Headings add up; paragraphs, lists and quotations count up to a limit."""
    upto = lambda name, most: F.least(counts[name] / F.lit(float(most)), F.lit(1.0))
    total = counts["h1"] * 0.2 + counts["h2"] * 0.15 + counts["h3"] * 0.1 + upto("paragraphs", 5) * 0.25 + upto("lists", 3) * 0.15 + upto("blockquotes", 2) * 0.15
    return F.least(total, F.lit(1.0))


def readability(text: Column, ws: Column | None = None) -> Column:
    """Closeness of sentence and word length to 17.5 words and 5 letters; 0 below 50 characters.

    ``ws`` are the words of the text, where they are known already.
    """
    ws = words(text) if ws is None else ws
    n = F.size(ws)
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: ~s.rlike(f"^{SPACE}*$")))
    by_sentence = 1 - F.abs(n / F.nullif(sentences, F.lit(0)) - 17.5) / 30
    by_word = 1 - F.abs(F.length(F.array_join(ws, "")) / F.nullif(n, F.lit(0)) - 5) / 10
    score = clamp01(0.6 * by_sentence + 0.4 * by_word)
    return F.when(text.isNull() | (F.length(text) < 50), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def freshness(days: Column) -> Column:
    """1 for unknown or negative ages, falling to 0.7 at a year."""
    return F.when(days.isNull() | (days < 0), 1.0).otherwise(F.greatest(F.lit(0.7), 1 - F.least(days, F.lit(365)) / 365.0 * 0.3))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def density(text: Column, keywords: Column, ws: Column | None = None) -> Column:
    """Struct of global density, largest density of a sliding window, and stuffing score.

    Windows of 100 words start every 50; the last ones are shorter. ``ws`` are
    the words of the text, where they are known already.
    """

    def scored(hits: Column) -> Column:
        n = F.size(hits)
        whole = F.coalesce(F.aggregate(hits, F.lit(0), lambda a, x: a + x) / F.nullif(n, F.lit(0)), F.lit(0.0))
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(STEP)))
        share = F.transform(starts, lambda i: F.aggregate(F.slice(hits, i + 1, F.lit(WINDOW)), F.lit(0), lambda a, x: a + x) / F.least(F.lit(WINDOW), n - i))
        both = F.struct(whole.alias("whole"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("local"))
        return _let(both, lambda d: F.struct(d["whole"].alias("global_density"), d["local"].alias("max_density"), F.least(F.lit(1.0), F.when(d["whole"] > 0, d["local"] / (d["whole"] + 0.001)).otherwise(0.0) / 5.0).alias("stuffing")))

    usable = (F.coalesce(text, F.lit("")) != "") & (F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0)
    none = F.struct(F.lit(0.0).alias("global_density"), F.lit(0.0).alias("max_density"), F.lit(0.0).alias("stuffing"))
    low = words(F.lower(text)) if ws is None else F.transform(ws, lambda w: F.lower(w))
    marked = _let(F.transform(keywords, lambda k: F.lower(k)), lambda kw: F.transform(low, lambda w: F.coalesce(F.array_contains(kw, w), F.lit(False)).cast("int")))
    return F.when(usable, _let(marked, scored)).otherwise(none)


def content_quality(pages: DataFrame, owners: DataFrame, snapshot_compat: bool = False) -> DataFrame:
    """doc_id and the rounded scores of each page; a page without text has 0, and 1 where nothing speaks against it.

    A page is a copy if another page owns its fingerprint (content_fingerprint,
    doc_id); with ``snapshot_compat`` it is one as soon as anyone does. Texts become scores
    before anything is shuffled; repeated rows count once.
    """
    text, markup, keywords = F.col("content_text"), F.col("html_text"), F.col("keywords")
    empty = F.coalesce(text, F.lit("")) == ""
    # the words are a column of their own, used by three scores
    pages = pages.withColumn("_ws", words(text))
    ws = F.col("_ws")
    n = F.coalesce(F.nullif(F.col("word_count"), F.lit(0)), F.size(ws))
    has_keywords = F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0
    parts = {
        "length": F.when(empty, 0.0).otherwise(length_score(n)),
        "structure": F.when(empty, 0.0).otherwise(structure_score(element_counts(markup))),
        "readability": F.when(empty, 0.0).otherwise(readability(text, ws)),
        "keywords": F.when(empty | ~has_keywords, 1.0).otherwise(1 - density(text, keywords, ws)["stuffing"]),
        "freshness": F.when(empty, 1.0).otherwise(freshness(F.col("days_old"))),
    }
    narrow = pages.select("doc_id", F.col("content_fingerprint").alias("fp"), empty.alias("_empty"), *[v.alias(f"_{k}") for k, v in parts.items()]).dropDuplicates(["doc_id"])
    own = owners.select(F.col("content_fingerprint").alias("fp"), F.col("doc_id").alias("_owner"))
    copied = F.col("_owner").isNotNull() & (F.lit(True) if snapshot_compat else F.col("_owner") != F.col("doc_id"))
    scored = narrow.join(own, "fp", "left").withColumn("_originality", F.when(~F.col("_empty") & copied, 0.2).otherwise(1.0))
    total = sum((F.col(f"_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return scored.select("doc_id", *[rounded(F.col(f"_{k}")).alias(f"{k}_score") for k in WEIGHTS], rounded(F.when(F.col("_empty"), 0.0).otherwise(total)).alias("overall"))
