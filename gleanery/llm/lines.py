"""Lines that many documents of one site share.

A document's lines are a sequence of line identifiers; the lines that repeat
within a site are its frequent sequences, mined by PrefixSpan with every step a
distributed aggregation:

* the first projection counts, for each site and line identifier, the distinct
  documents that hold it, and drops the infrequent ones from the sequences, so
  that later steps see across gaps of a document's own and of blank lines;
* a frequent line whose every occurrence is followed by the same line, which
  itself follows nothing else, is grown by it without losing an occurrence, and so
  on: each line falls into one closed block, a sequence of the site (``blocks``);
* a longer sequence grows from a frequent prefix by the block that follows it in
  the projected documents, and again its distinct documents are counted, until no
  sequence of a length is frequent (``frequent_sequences``).

What is deleted are the occurrences of the closed blocks, single lines included.
Support never rises with length, so every longer frequent sequence consists of
blocks, and its occurrences hold no further line.

Counts are pre-aggregated before every shuffle and keyed by (site, line), so a
site with a third of all documents is spread over many tasks; the join back to
the lines treats the most frequent lines apart (``join_counted``).

Defined cases: null, empty and blank texts have no cases; lines without letters
never are cases; repeated rows of a document count once; a document without a
row in the host table takes the host of its url.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.site import site_of
from gleanery.operators.scale import cut, join_counted

#: Distinct documents of a site that must hold a line for it to count as repeated.
MIN_SUPPORT = 5
#: Lengths of sequences after which the found ones are written as one table.
LENGTHS = 16


def line_keys(text: Column) -> Column:
    """For each line 16 bytes that are equal for lines of the same words of the same letters, null without letters.

    Case is folded (a sharp s equals its capital form ``SS``); everything but letters separates words.
    The text is folded as a whole, and words are hashed in a step of their own, so that each is done once.
    """
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    words = F.transform(lines_of(folded), lambda line: F.trim(F.regexp_replace(line, r"[^\p{L}]+", " ")))
    return F.transform(words, lambda w: F.unhex(F.md5(F.nullif(w, F.lit("")))))


def lines_of(text: Column) -> Column:
    """The lines of a text in order; a carriage return before the break is dropped."""
    return F.split(text, r"\r?\n")


def page_sites(profile: DataFrame) -> DataFrame:
    """doc_id and site of each page of the link profile."""
    return profile.groupBy("doc_id").agg(F.first(F.struct("domain", "url")).alias("_p")).select("doc_id", site_of(F.col("_p.domain"), F.col("_p.url")).alias("site"))


def line_table(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """site, doc_id, line_no and key of every line with letters, each once.

    Texts are reduced to their keys before anything is shuffled.
    """
    keys = line_keys(F.col("content_text"))
    # the filter is on the text, since one on the keys would compute them twice
    narrow = pages.filter("content_text is not null").select("doc_id", F.col("url").alias("_url"), keys.alias("_keys"))
    one = narrow.groupBy("doc_id").agg(F.first(F.struct("_url", "_keys")).alias("_r")).select("doc_id", "_r._url", "_r._keys")
    placed = one.join(page_sites(profile), "doc_id", "left").withColumn("site", F.coalesce("site", site_of(F.lit(None).cast("string"), F.col("_url"))))
    return placed.select("site", "doc_id", F.posexplode("_keys").alias("_at", "key")).filter("key is not null").select("site", "doc_id", (F.col("_at") + 1).alias("line_no"), "key")


def frequent_items(lines: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """First projection: site, key, support (distinct documents) and uses (lines) of the repeated lines."""
    per_doc = lines.groupBy("site", "key", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_doc.groupBy("site", "key").agg(F.count(F.lit(1)).alias("support"), F.sum("_n").alias("uses"))
    return counts.filter(F.col("support") >= min_support)


def repeated_lines(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """site, doc_id, line_no, key and support of every line that the first projection keeps."""
    lines = cut(line_table(pages, profile))
    items = cut(frequent_items(lines, min_support))
    return join_counted(lines, items, ["site", "key"], "uses", lines.count()).select("site", "doc_id", "line_no", "key", "support")


def _glued(seq: DataFrame) -> DataFrame:
    """site, key and uses of every frequent line, and whether it always follows one line that is always followed by it."""
    ends = [F.count(F.lit(1)).alias("uses"), F.max("support").alias("support")]
    for side in ("before", "after"):
        ends += [F.min(side).alias(f"_{side}"), ((F.count(side) == F.count(F.lit(1))) & (F.min(side) == F.max(side))).alias(f"_one_{side}")]
    items = cut(seq.groupBy("site", "key").agg(*ends))
    leads = items.filter("_one_after").select("site", F.col("key").alias("_before"), F.col("_after").alias("key"), F.lit(True).alias("_led"))
    joined = items.join(leads, ["site", "_before", "key"], "left")
    return cut(joined.select("site", "key", "uses", (F.col("_one_before") & F.coalesce("_led", F.lit(False)) & (F.col("key") != F.col("_before"))).alias("glued")))


def blocks(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """site, doc_id, line_no, key, support, block and length: the lines of each occurrence of a closed block.

    ``block`` numbers the occurrences in a document, ``length`` is their number of lines.
    """
    found = repeated_lines(pages, profile, min_support)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    seq = cut(found.withColumn("before", F.lag("key").over(order)).withColumn("after", F.lead("key").over(order)))
    marked = join_counted(seq, _glued(seq), ["site", "key"], "uses", max(seq.count(), 1))
    numbered = marked.withColumn("block", F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(order))
    return numbered.select("site", "doc_id", "line_no", "key", "support", "block", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "block")).cast("int").alias("length"))


def deleted_lines(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id and line_no of every line in an occurrence of a frequent sequence of its site."""
    return blocks(pages, profile, min_support).select("doc_id", "line_no")


def frequent_sequences(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """site, sequence (hex), length in lines, support, and doc_id, first and last line of an occurrence of every frequent sequence of closed blocks.

    At each length the projected database holds, for each occurrence of a
    frequent prefix, its document and end; it grows by the block that follows.
    The loop ends when no sequence of a length is frequent.
    """
    lines = blocks(pages, profile, min_support)
    one = lines.groupBy("site", "doc_id", F.col("block").alias("end")).agg(F.min(F.struct("line_no", "key")).alias("_h"), F.max("line_no").alias("last"), F.max("length").alias("length"))
    prefix = cut(one.select("site", "doc_id", "end", F.col("_h.key").alias("pattern"), F.col("_h.line_no").alias("first"), "last", "length"))
    nxt = prefix.select("doc_id", (F.col("end") - 1).alias("end"), F.col("last").alias("_last"), F.col("length").alias("_more"), F.col("pattern").alias("_next"))
    seen = F.min(F.struct("doc_id", "first", "last")).alias("_e")

    def counted(grown: DataFrame) -> DataFrame:
        per_doc = grown.groupBy("site", "pattern", "length", "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("first").alias("first"), F.min("last").alias("last"))
        return per_doc.groupBy("site", "pattern", "length").agg(F.count(F.lit(1)).alias("support"), F.sum("_n").alias("uses"), seen)

    def shown(frequent: DataFrame) -> DataFrame:
        return frequent.select("site", F.lower(F.hex("pattern")).alias("sequence"), "length", "support", "_e.doc_id", F.col("_e.first").alias("first_line"), F.col("_e.last").alias("last_line"))

    out, held = shown(counted(prefix)), None
    for step in count(2):
        grown = (
            prefix.join(nxt, ["doc_id", "end"])
            .select("site", "doc_id", (F.col("end") + 1).alias("end"), F.unhex(F.md5(F.concat("pattern", "_next"))).alias("pattern"), "first", F.col("_last").alias("last"), (F.col("length") + F.col("_more")).alias("length"))
        )
        # the copies of the step before last are free
        grown = cut(grown, replaces=held)
        held = grown
        frequent = cut(counted(grown).filter(F.col("support") >= min_support))
        if frequent.isEmpty():
            break
        out = out.unionByName(shown(frequent))
        # long sequences make many steps: the plan stays small
        out = cut(out) if step % LENGTHS == 0 else out
        prefix = join_counted(grown, frequent.select("site", "pattern", "length", "uses"), ["site", "pattern", "length"], "uses", max(grown.count(), 1)).select(*prefix.columns)
    return out


def without_repeated_lines(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id and content_text of each page without the repeated lines; a null text stays null."""
    drop = deleted_lines(pages, profile, min_support).groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop"))
    one = pages.select("doc_id", "content_text").dropDuplicates(["doc_id"]).join(drop, "doc_id", "left")
    numbered = F.transform(lines_of(F.col("content_text")), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), x["no"]), F.lit(False)))
    return one.select("doc_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("content_text"))
