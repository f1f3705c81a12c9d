"""Tokens, stop words, stems and distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English words that carry no topic.
STOPWORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
_CHUNK = r"[^ \t\n\r\f\x{0b}\x{a0}\x{2028}\x{2029}\x{3000}]+"
_CONTRACTED = r"(?:n['’]t|['’](?:s|re|ve|ll|d|m))$"


def tokens(text: Column, stop: bool = True) -> Column:
    """Words of letters only, in lower case and in order, without stop words.

    Chunks between spaces lose punctuation at their ends and contracted endings;
    a chunk that then isn't letters throughout is dropped.
    """
    chunks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_CHUNK), F.lit(0))
    bare = F.transform(chunks, lambda c: F.regexp_replace(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), _CONTRACTED, ""))
    return F.filter(bare, lambda w: w.rlike(r"^\p{L}+$") & (~w.isin(*sorted(STOPWORDS)) if stop else F.lit(True)))


def porter(word: str) -> str:
    """Stem of an English word by Porter's rules of 1980."""
    if len(word) <= 2 or not word.isascii():
        return word

    def cons(w, i):
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not cons(w, i - 1))

    def measure(w):
        kinds = "".join("c" if cons(w, i) else "v" for i in range(len(w)))
        return kinds.count("vc")

    def vowel(w):
        return any(not cons(w, i) for i in range(len(w)))

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w):
        return len(w) > 2 and cons(w, len(w) - 1) and not cons(w, len(w) - 2) and cons(w, len(w) - 3) and w[-1] not in "wxy"

    def swap(w, pairs, least):
        for old, new in pairs:
            if w.endswith(old):
                stem = w[: len(w) - len(old)]
                return stem + new if measure(stem) > least else w
        return w

    w = word
    # plurals
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: len(w) - len(old)] + new
            break
    # past and progressive forms
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for old in ("ed", "ing"):
            stem = w[: len(w) - len(old)]
            if w.endswith(old) and vowel(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffixes of the published rules, step by step.
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for old in ("ement", "ment", "ent", "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(old):
            stem = w[: len(w) - len(old)] + (old[0] if old in ("sion", "tion") else "")
            if measure(stem) > 1:
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or measure(stem) == 1 and not cvc(stem):
            w = stem
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stems of words, each distinct one of a batch computed once."""
    known = {w: porter(w) for w in words.dropna().unique()}
    return words.map(known).astype(object).where(words.notna(), None)


def with_stems(long: DataFrame, word: str = "term") -> DataFrame:
    """``long`` with its words stemmed; each distinct word of the table goes to Python once."""
    stems = long.select(word).distinct().withColumn("_stem", stem(word))
    return long.join(stems, word).drop(word).withColumnRenamed("_stem", word)
