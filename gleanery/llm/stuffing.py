"""Keyword-stuffed pages, link lists and tag lists.

A page's own text (its main body, so without site furniture and headline) is
reduced to the counts of its words, and its curve decides:

* windows rank the words of each page, and a line is fitted to the logarithms of
  frequency and rank: stuffing shows as an extreme slope (a few words over and
  over) or an extreme residual (a plateau of equally frequent words that ends in
  a cliff);
* the whole word distribution is compared with that of prose: the words of a
  language are ordered by the pages that hold them, and the page's words fall into
  bands of ranks that double, with a band for words of no other page. Prose of any
  language fills the bands alike, keywords and link titles do not. The measure is
  the Jensen-Shannon divergence from the mean distribution of prose in the same
  language and length band.

A measure is extreme if it is ``DEVIATIONS`` robust deviations from the median of
same-language prose at comparable lengths; many outgoing links lower that a
little. Nothing of this needs to know the words of a language: pages in none
of the languages of ``FUNCTION_WORDS`` have their own order of words and are
compared with the prose of all languages.

An exact check follows: in the languages known, a page whose lines are sentences
to ``PROSE_MOST`` of its letters is no case, lists of amounts (ingredients, data
sheets) left out of the count.

Defined cases: null, empty and blank texts and pages without own text are no
cases; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.boilerplate import line_blocks
from gleanery.operators.scale import cut, join_counted

#: Share of a page's letters in sentences from which on it is no case, and that makes it a page of prose.
PROSE_MOST, PROSE_LEAST = 0.8, 0.5
#: Share of function words that makes a line of at least LINE_WORDS words a sentence.
LINE_SHARE, LINE_WORDS = 0.2, 5
#: Share of a language's function words that makes a page one of that language.
LANGUAGE_SHARE = 0.12
#: Robust deviations from the median that are extreme; the fit of a curve varies more among prose than its divergence.
DEVIATIONS = {"slope": 6.0, "residual": 6.0, "divergence": 3.5}
#: With so many outgoing links this part of them is enough.
MANY_LINKS, LINKED = 100, 0.85
#: Bands of ranks (the last holds all further ones), with one more for words of no other page; what is added to each share.
BANDS, ADDED = 15, 0.01
#: Median divergence of prose from equal bands (Zipf's law), for collections without any prose.
NO_PROSE = 0.05
#: Pages of prose that a language and length band needs for a distribution of its own.
ENOUGH = 20

# Function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or but nor not no neither either of to in on at by for from with without within into onto under over between behind beside before after along across near during until while when where why who whom whose which what how than then that this these those there here it its he she they them their his her our we us you your i my me is are was were be been being has have had do does did can could may might must shall should will would if because so as every each all any some most more many much few only also again very just says said".split(),
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber nicht kein keine weder noch von zu zum zur im in an am auf bei mit ohne für aus nach vor über unter zwischen hinter neben seit bis während wenn wann wo warum wer wen was wie als dass dieser diese dieses es er sie wir ihr ihre sein seine unser unsere ich ist sind war waren wird werden wurde hat haben hatte kann können muss soll jeder jede alle einige mehr viel nur auch wieder sehr nichts immer so".split(),
    "fr": "le la les l un une des du de d et ou mais ni ne pas plus à au aux en dans sur sous par pour avec sans entre derrière devant avant après pendant jusque quand où pourquoi qui que qu quoi dont quel quelle comme si il elle ils elles nous vous on je tu se son sa ses leur leurs notre nos votre ce cet cette ces est sont était être a ont avait fait faut fallu peut chaque tout tous toute même aussi très bien y rien encore toujours".split(),
    "es": "el la los las un una unos unas de del y e o u pero ni no a al en con sin por para sobre bajo entre tras detrás antes después durante hasta desde cuando donde quien quién que qué cual cómo como si se su sus lo le les nos nuestro nuestra yo tú él ella ellos más muy es son era fue ser está están estaba ha han había cada todo todos toda este esta estos ese esa también ya siempre nada".split(),
}
# Units that mark a list of amounts.
_AMOUNT = r"(?i)(?:^|\s)\d+([.,]\d+)?\s?(x|g|kg|mg|ml|cl|dl|l|cm|mm|m|km|w|kw|v|a|pcs|st|stk|pc|pz|ud|uds|tbsp|tsp|el|tl|°c|oz|lb)(?:\s|[.,;:!?…)\]]|$)"
_TAGGED = r"(?i)https?://|#\p{L}|\b(sku|no\.)\s?\d"


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"\p{L}+"), F.lit(0))


_ANY = sorted({w for words in FUNCTION_WORDS.values() for w in words})


def _hits(words: Column) -> Column:
    """Struct of the number of function words of each language; a third of all words are tested by language."""

    def by_language(known: Column) -> Column:
        return F.struct(*[F.size(F.filter(known, _tester(lang))).alias(lang) for lang in FUNCTION_WORDS])

    return F.element_at(F.transform(F.array(F.filter(words, lambda w: w.isin(_ANY))), by_language), 1)


def _tester(lang: str):
    return lambda w: w.isin(FUNCTION_WORDS[lang])


def own_lines(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, words, letters (characters but spaces) and amounts of each line of own text; the texts go through one shuffle, by page."""
    keep = line_blocks(pages, profile).filter("main and not headline").groupBy("doc_id").agg(F.collect_set("line_no").alias("_keep"))
    texts = pages.select("doc_id", "content_text").filter("content_text is not null")
    once = keep.join(texts, "doc_id").dropDuplicates(["doc_id"])
    numbered = F.transform(F.split("content_text", r"\r?\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    lines = once.select("doc_id", F.explode(F.filter(numbered, lambda x: F.array_contains("_keep", x["no"]))).alias("_l")).select("doc_id", F.col("_l.line").alias("line"))
    amounts = F.col("line").rlike(_AMOUNT) & ~F.col("line").rlike(_TAGGED)
    return lines.select("doc_id", _words(F.col("line")).alias("words"), F.length(F.replace("line", F.lit(" "), F.lit(""))).alias("letters"), amounts.alias("amounts"))


def _whole(lines: DataFrame) -> DataFrame:
    """doc_id, lang, prose (share of letters in sentences) and function_share of each page, and its words as hashes."""
    hits = lines.withColumn("_hits", _hits(F.col("words")))
    scored = hits.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens"), "letters", "amounts", *[F.col(f"_hits.{lang}").alias(f"_{lang}") for lang in FUNCTION_WORDS])
    best, n = F.greatest(*[F.col(f"_{lang}") for lang in FUNCTION_WORDS]), F.size("tokens")
    sentence = (n >= LINE_WORDS) & (best >= n * LINE_SHARE)
    whole = scored.withColumn("_prose", sentence).withColumn("_best", best).groupBy("doc_id").agg(
        F.flatten(F.collect_list("tokens")).alias("tokens"),
        *[F.sum(f"_{lang}").alias(f"_{lang}") for lang in FUNCTION_WORDS],
        F.sum("_best").alias("_function"),
        F.sum(F.when(F.col("_prose"), F.col("letters")).otherwise(0)).alias("_in_prose"),
        F.sum(F.when(F.col("_prose") | ~F.col("amounts"), F.col("letters")).otherwise(0)).alias("_letters"),
    )
    most = F.greatest(*[F.col(f"_{lang}") for lang in FUNCTION_WORDS])
    lang = F.coalesce(*[F.when((F.col(f"_{l}") == most) & (most >= LANGUAGE_SHARE * F.size("tokens")), F.lit(l)) for l in FUNCTION_WORDS], F.lit("und"))
    return whole.filter("size(tokens) > 0").select(
        "doc_id", lang.alias("lang"), (F.col("_in_prose") / F.nullif(F.col("_letters"), F.lit(0))).alias("prose"), (F.col("_function") / F.size("tokens")).alias("function_share"), "tokens"
    )


def _curves(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, lang, token and f (count) of each word of each page; doc_id, slope and residual of its rank-frequency curve."""
    words = whole.select("doc_id", "lang", "tokens").repartition("doc_id").select("doc_id", "lang", F.explode("tokens").alias("token")).groupBy("doc_id", "lang", "token").agg(F.count(F.lit(1)).alias("f"))
    ranked = cut(words.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("f")))))
    x, y = F.log("rank"), F.log("f")
    explained = F.nullif(F.regr_sxy(y, x), F.lit(0.0)) ** 2 / F.nullif(F.regr_sxx(y, x), F.lit(0.0))
    fit = ranked.groupBy("doc_id").agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.sqrt(F.greatest(F.coalesce((F.regr_syy(y, x) - explained) / F.count(F.lit(1)), F.lit(0.0)), F.lit(0.0))).alias("residual"),
    )
    return ranked.drop("rank"), fit


def _shares(words: DataFrame) -> DataFrame:
    """doc_id and bands: the share of a page's words in each band of ranks of its language.

    A word's rank is the number of words in at least as many pages; the least
    number of pages of each band is one short list a language, so no vocabulary is
    ordered in one task, and words in very many pages are joined apart.
    """
    frequency = cut(words.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df")))
    ladder = frequency.groupBy("lang", "df").agg(F.count(F.lit(1)).alias("n"))
    # one row for each number of pages that occurs
    rank = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("df")))
    steps = ladder.withColumn("band", F.least(F.floor(F.log2(rank)), F.lit(BANDS - 1)).cast("int")).groupBy("lang", "band").agg(F.min("df").alias("least"))
    lists = steps.groupBy("lang").agg(F.collect_list("least").alias("_least"))
    banded = frequency.join(F.broadcast(lists), "lang").withColumn("band", F.when(F.col("df") == 1, F.lit(BANDS)).otherwise(F.size(F.filter("_least", lambda x: x > F.col("df"))))).drop("_least")
    placed = join_counted(words, banded, ["lang", "token"], "df", max(words.count(), 1))
    sums = placed.groupBy("doc_id").agg(F.sum("f").alias("_n"), *[F.sum(F.when(F.col("band") == k, F.col("f")).otherwise(0)).alias(f"_{k}") for k in range(BANDS + 1)])
    return sums.select("doc_id", F.array(*[(F.col(f"_{k}") / F.col("_n") + ADDED) / (1 + (BANDS + 1) * ADDED) for k in range(BANDS + 1)]).alias("bands"))


def _mean(bands: str) -> Column:
    return F.array(*[F.avg(F.element_at(bands, k + 1)) for k in range(BANDS + 1)])


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats."""

    def half(x: Column, other: Column) -> Column:
        return F.aggregate(F.zip_with(x, other, lambda a, b: a * F.log(2 * a / (a + b))), F.lit(0.0), lambda s, v: s + v)

    return (half(p, q) + half(q, p)) / 2


def _away(column: str, side: str) -> Column:
    """Distance from the median in robust deviations; divergence counts upwards only.

    Where no prose of the length is known, only divergence counts, from ``NO_PROSE``.
    """
    known = (F.coalesce(f"_m_{column}", f"_m0_{column}"), F.coalesce(f"_w_{column}", f"_w0_{column}"))
    centre, width = known if side == "both" else (F.coalesce(known[0], F.lit(NO_PROSE)), F.coalesce(known[1], F.lit(0.0)))
    distance = (F.col(column) - centre) / F.greatest(1.4826 * width, F.lit(0.02))
    return F.coalesce(F.abs(distance) if side == "both" else distance, F.lit(0.0))


_MEASURES = {"slope": "both", "residual": "both", "divergence": "up"}


def _medians(prose: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Median and median distance from it of each measure."""
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centre = prose.groupBy(*by).agg(*[middle(c).alias(f"_m{prefix}_{c}") for c in _MEASURES])
    apart = prose.join(F.broadcast(centre), by).groupBy(*by).agg(*[middle(F.abs(F.col(c) - F.col(f"_m{prefix}_{c}"))).alias(f"_w{prefix}_{c}") for c in _MEASURES])
    return centre.join(apart, by)


def judged(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, lang, band of length, tokens, prose, function_share, the measures and their distances from prose, outbound links and the verdict ``stuffed``.

    Bands are powers of two of the word count, so the tables of distributions and
    medians have at most a few hundred rows however large the crawl; they are broadcast.
    """
    whole = cut(_whole(own_lines(pages, profile)))
    words, fit = _curves(whole)
    links = profile.groupBy("doc_id").agg(F.max("outbound_link_count").alias("outbound"))
    flat = whole.select("doc_id", "lang", "prose", "function_share", F.size("tokens").alias("tokens")).withColumn("band", F.floor(F.log2("tokens")).cast("int"))
    rows = cut(flat.join(fit, "doc_id").join(_shares(words), "doc_id").join(links, "doc_id", "left").withColumn("outbound", F.coalesce("outbound", F.lit(0))))
    prose = rows.filter((F.col("lang") != "und") & (F.col("prose") >= PROSE_LEAST))
    own = prose.groupBy("lang", "band").agg(_mean("bands").alias("_q"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= ENOUGH).drop("_n")
    every = prose.groupBy("band").agg(_mean("bands").alias("_q0"))
    # the mean of all prose, one row, for lengths without any
    general = prose.agg(_mean("bands").alias("q")).first().q
    overall = F.array(*[F.lit(x if x is not None else 1 / (BANDS + 1)).cast("double") for x in general])
    compared = rows.join(F.broadcast(own), ["lang", "band"], "left").join(F.broadcast(every), "band", "left")
    measured = cut(compared.withColumn("divergence", _divergence(F.col("bands"), F.coalesce("_q", "_q0", overall))).drop("bands", "_q", "_q0"))
    known = measured.filter((F.col("lang") != "und") & (F.col("prose") >= PROSE_LEAST))
    placed = measured.join(F.broadcast(_medians(known, ["lang", "band"], "")), ["lang", "band"], "left").join(F.broadcast(_medians(known, ["band"], "0")), "band", "left")
    placed = placed.select("*", *[_away(c, side).alias(f"{c}_away") for c, side in _MEASURES.items()])
    enough = F.when(F.col("outbound") >= MANY_LINKS, LINKED).otherwise(1.0)
    extreme = F.greatest(*[F.col(f"{c}_away") / DEVIATIONS[c] for c in _MEASURES]) >= enough
    sentences = (F.col("lang") != "und") & (F.col("prose") >= PROSE_MOST)
    stuffed = F.coalesce(extreme & ~F.coalesce(sentences, F.lit(False)), F.lit(False))
    return placed.select("doc_id", "lang", "band", "tokens", "prose", "function_share", "divergence", "divergence_away", "slope", "slope_away", "residual", "residual_away", "outbound", stuffed.alias("stuffed"))


def stuffed_pages(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id of the pages whose own text is keywords, links or tags."""
    return judged(pages, profile).filter("stuffed").select("doc_id")
