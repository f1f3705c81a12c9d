"""How characteristic each term is of its record.

Dunning's log-likelihood ratio over the two-by-two table of a term's count and
the other terms' count, in the record and in the rest of the collection. The
score is signed: positive where the term is more frequent in the record than in
the rest, negative where it is rarer, so terms found everywhere score near zero
or below and rare terms that few records share score high.

Terms are counted per record first; the collection's totals come from those
counts by pre-aggregated shuffles, and only terms that hold more than a
thousandth of all rows are joined by broadcast (``join_counted``).

Defined cases: null and empty arrays give no rows; null terms are left out, empty
strings are terms; a term given twice in an array counts twice; repeated rows of
a record count once; a collection of a single record has score 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import cut, join_counted


def record_terms(records: DataFrame) -> DataFrame:
    """doc_id, term and tf of every record, each record once."""
    once = records.select("doc_id", "words").filter("doc_id is not null and size(words) > 0").dropDuplicates(["doc_id"])
    return once.select("doc_id", F.explode("words").alias("term")).filter("term is not null").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed ratio of the table: a of a + c in the record, b of b + d in the rest."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    cells = _x_log_x(a) + _x_log_x(b) + _x_log_x(c) + _x_log_x(d)
    margins = _x_log_x(a + b) + _x_log_x(c + d) + _x_log_x(a + c) + _x_log_x(b + d)
    ratio = F.greatest(2 * (cells - margins + _x_log_x(a + b + c + d)), F.lit(0.0))
    return F.when(a * (b + d) >= b * (a + c), ratio).otherwise(-ratio)


def distinctive_terms(records: DataFrame) -> DataFrame:
    """doc_id, term, tf, doc_freq and score of every term of every record."""
    counts = cut(record_terms(records))
    of_doc = counts.groupBy("doc_id").agg(F.sum("tf").alias("_doc"))
    of_term = cut(counts.groupBy("term").agg(F.sum("tf").alias("_term"), F.count(F.lit(1)).alias("doc_freq")))
    total = of_term.agg(F.coalesce(F.sum("_term"), F.lit(0)).alias("t"), F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("n")).first()
    rows = join_counted(counts.join(of_doc, "doc_id"), of_term, ["term"], "doc_freq", total.n)
    a, term, doc = F.col("tf"), F.col("_term"), F.col("_doc")
    score = log_likelihood(a, term - a, doc - a, F.lit(total.t) - doc - term + a)
    return rows.select("doc_id", "term", "tf", "doc_freq", score.alias("score"))
