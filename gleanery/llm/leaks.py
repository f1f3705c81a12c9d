"""Evaluation passages that stand in a corpus.

The evaluation items are indexed for BM25, and every passage of the corpus is a
query against them. A passage is ``PASSAGE`` words long and overlaps the next by
one word less than a match, so each run of ``RUN`` words lies within a passage.

The threshold loses nothing: a passage that holds ``RUN`` consecutive words of
an item scores at least what the weakest such run of that item scores by
itself. Weights are divided by that least score, so every item's threshold is 1.
The index is inverted and sparse: each term has a list of its items with their
weights, in order, cut into blocks of items with the term's maximum weight in the
block. Items are ordered by their least score, so that a block's maxima are alike.

Search is block-max WAND, for a batch of passages at once. The terms of a passage
are sorted by their greatest weight; those whose greatest weights together stay
below 1 can make no candidate, so only the lists of the others, behind this pivot,
are opened. A block they lead to is skipped if its maxima, and then the maxima of
all terms in it, stay below 1 in sum; only what is left is scored item by item.
Candidates at or above 1 are verified word by word.

The items are the stated query set, of any number: they are indexed in parallel
in shards of about ``ITEMS_A_SHARD``, which are broadcast one by one, each of
bounded size. The corpus is read once: a task turns a group of texts into word
hashes and takes them through all shards.

Words: runs of letters and digits after entities are resolved, tags and
invisible characters removed, and case and accents folded. Words are compared by
64-bit hashes.

Defined cases: null, empty and wordless texts and items match nothing; an item
of fewer than ``RUN`` words must occur whole; equal items are all reported;
repeated rows give one result.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a match.
RUN = 10
#: Words of a passage.
PASSAGE = 64
#: Items of a block of the posting lists, and of a shard of the index.
ITEMS_A_BLOCK = 8
ITEMS_A_SHARD = 20_000
#: BM25's saturation and length normalisation.
K1, B = 1.5, 0.75
#: Words of the texts that a task takes through the shards together, and list entries opened at once.
WORDS_AT_ONCE, ENTRIES_AT_ONCE = 1_000_000, 2_000_000

_INLINE_TAGS = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_TAG_WITHIN = re.compile(rf"</?(?:{_INLINE_TAGS})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.DOTALL)
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")
_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, folded."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _TAG_WITHIN.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", _UNSEEN.sub("", text)))
        return _WORD.findall(text.casefold())
    return _WORD.findall(text.lower())


class Hashes(dict):
    """64-bit hashes of words, remembered; forgetting them changes nothing."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) - (1 << 63)
        return value


def spread(starts, sizes):
    """Positions of several ranges, one after the other, and the number of each one's range."""
    import numpy as np

    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), owner


def distinct(values):
    """The distinct values in order; sorting beats hashing where most repeat in runs."""
    import numpy as np

    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def build(items: list[tuple[int, list[int]]]) -> dict:
    """The index of items (identifier, word hashes): plain arrays of the posting lists and their blocks."""
    import numpy as np

    items = [(item, words) for item, words in items if len(words)]
    n = len(items)
    lengths = np.array([len(w) for _, w in items], "int64")
    flat = np.array([w for _, words in items for w in words], "int64")
    terms, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    # one entry for each item and term
    pairs, tf = np.unique(owner * len(terms) + at, return_counts=True)
    item, term = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(lengths.mean(), 1)))
    of = dict(zip(pairs.tolist(), weight.tolist()))
    begins = np.cumsum(lengths) - lengths
    least = np.zeros(n)
    for i in range(n):
        own = at[begins[i] : begins[i] + lengths[i]].tolist()
        size = min(RUN, len(own))
        least[i] = min(sum(of[i * len(terms) + t] for t in set(own[k : k + size])) for k in range(len(own) - size + 1))
    order = np.argsort(least, kind="stable")
    place = np.empty(n, "int64")
    place[order] = np.arange(n)
    # the runs of the items, by their number of words, for the check of the candidates
    runs = {}
    for size in np.unique(np.minimum(lengths, RUN)).tolist():
        concerned = np.flatnonzero(np.minimum(lengths, RUN) == size)
        position, which = spread(begins[concerned], lengths[concerned] - size + 1)
        hashed = _runs(flat, size)[position]
        by_hash = np.argsort(hashed, kind="stable")
        runs[size] = (hashed[by_hash], place[concerned[which]][by_hash], position[by_hash])
    weight, item = (weight / least[item] * (1 + 1e-4)).astype("float32"), place[item]
    by_term = np.lexsort((item, term))
    item, term, weight = item[by_term], term[by_term], weight[by_term]
    blocks = -(-n // ITEMS_A_BLOCK)
    keys = term * blocks + item // ITEMS_A_BLOCK
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, "int64")
    keys = keys[first]
    maxima = np.maximum.reduceat(weight, first) if len(first) else weight
    lists = np.searchsorted(keys, np.arange(len(terms) + 1) * blocks)
    return {
        "terms": terms, "blocks": blocks, "item": item.astype("int32"), "weight": weight,
        "keys": keys, "maxima": maxima, "first": np.r_[first, len(item)], "lists": lists,
        "greatest": np.maximum.reduceat(maxima, lists[:-1]) if len(terms) else maxima,
        "ids": np.array([items[k][0] for k in order], "int64"), "flat": flat, "runs": runs,
    }


def search(index: dict, flat, ends) -> set[tuple[int, int]]:
    """Number of the text and item of each verified match, for texts of word hashes ``flat`` that end at ``ends``."""
    import numpy as np

    found: set[tuple[int, int]] = set()
    candidates: list = []
    terms, blocks = index["terms"], index["blocks"]
    if not len(terms) or not len(flat):
        return found
    ends = np.asarray(ends)
    begins = np.r_[0, ends[:-1]]
    step = PASSAGE - RUN + 1
    count = np.where(ends > begins, np.maximum(1, -(-(ends - begins - RUN + 1) // step)), 0)
    nth, text = spread(np.zeros(len(count), "int64"), count)
    start = begins[text] + nth * step
    stop = np.minimum(start + PASSAGE, ends[text])
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    known = terms[at] == flat
    where, passage = spread(start, stop - start)
    held = known[where]
    pairs = distinct(passage[held] * len(terms) + at[where[held]])
    passage, term = pairs // len(terms), pairs % len(terms)
    # within each passage terms by their greatest weight; the pivot is where the sum reaches the threshold
    great = index["greatest"][term]
    order = np.lexsort((great, passage))
    passage, term, great = passage[order], term[order], great[order].astype("float64")
    heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, "int64")
    if not len(heads):
        return found
    sums = np.cumsum(great)
    within = sums - np.repeat(sums[heads] - great[heads], np.diff(np.r_[heads, len(passage)]))
    tails = np.r_[heads[1:], len(passage)]
    hopeful = within[tails - 1] >= 1 - 1e-6
    opened = within >= 1 - 1e-6
    below = np.where(opened, 0.0, within)
    base = np.maximum.reduceat(below, heads)
    sizes = np.where(opened, np.diff(index["lists"])[term], 0)
    cost = np.add.reduceat(sizes, heads)
    chunk = np.cumsum(cost + blocks) // ENTRIES_AT_ONCE
    for c in np.unique(chunk[hopeful]):
        mine = np.flatnonzero((chunk == c) & hopeful)
        rows, _ = spread(heads[mine], (tails - heads)[mine])
        rows = rows[opened[rows]]
        entry, who = spread(index["lists"][term[rows]], sizes[rows])
        at_block = index["keys"][entry] % blocks
        group = np.searchsorted(heads, rows[who], side="right") - 1
        # one cell for each passage and block of the chunk
        first_group = int(group[0])
        cells = (group - first_group) * blocks + at_block
        sums = np.bincount(cells, index["maxima"][entry])
        pair = np.flatnonzero(sums) + first_group * blocks
        bound = sums[pair - first_group * blocks] + base[pair // blocks]
        pair = pair[bound >= 1 - 1e-6]
        for low in range(0, len(pair), 20_000):
            part = pair[low : low + 20_000]
            group, block = part // blocks, part % blocks
            rows, owner = spread(heads[group], (tails - heads)[group])
            wanted = term[rows] * blocks + block[owner]
            spot = np.minimum(np.searchsorted(index["keys"], wanted), len(index["keys"]) - 1)
            hit = index["keys"][spot] == wanted
            spot, owner = spot[hit], owner[hit]
            alive = np.bincount(owner, index["maxima"][spot], len(part)) >= 1 - 1e-6
            spot, owner = spot[alive[owner]], owner[alive[owner]]
            post, which = spread(index["first"][spot], index["first"][spot + 1] - index["first"][spot])
            cell = owner[which] * ITEMS_A_BLOCK + index["item"][post] % ITEMS_A_BLOCK
            score = np.bincount(cell, index["weight"][post], len(part) * ITEMS_A_BLOCK)
            cell = np.flatnonzero(score >= 1 - 1e-6)
            group, block = group[cell // ITEMS_A_BLOCK], block[cell // ITEMS_A_BLOCK]
            candidates.append(passage[heads[group]] * len(index["ids"]) + block * ITEMS_A_BLOCK + cell % ITEMS_A_BLOCK)
    if not candidates:
        return found
    sure = np.intersect1d(np.concatenate(candidates), _overlaps(index, flat, start, stop))
    return set(zip(text[sure // len(index["ids"])].tolist(), index["ids"][sure % len(index["ids"])].tolist()))


def _runs(flat, size: int):
    """A hash of each run of ``size`` words."""
    import numpy as np

    out = np.zeros(max(0, len(flat) - size + 1), "uint64")
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(out)].view("uint64")
    return out


def _overlaps(index: dict, flat, start, stop):
    """Passages and items, as passage * items + item, that share ``RUN`` consecutive words, or all of a shorter item, compared word by word."""
    import numpy as np

    flat = np.ascontiguousarray(flat)
    out = [np.zeros(0, "int64")]
    for size, (runs, item, at) in index["runs"].items():
        here = _runs(flat, size)
        low, high = np.searchsorted(runs, here), np.searchsorted(runs, here, side="right")
        where = np.flatnonzero(high > low)
        entry, owner = spread(low[where], (high - low)[where])
        where, item, at = where[owner], item[entry], at[entry]
        same = np.ones(len(where), bool)
        for k in range(size):
            same &= flat[where + k] == index["flat"][at + k]
        where, item = where[same], item[same]
        # the passages that hold the whole run: their starts lie before it, their ends behind it
        first, last = np.searchsorted(stop, where + size), np.searchsorted(start, where, side="right")
        passage, owner = spread(first, np.maximum(last - first, 0))
        out.append(passage * len(index["ids"]) + item[owner])
    return np.unique(np.concatenate(out))


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, items = Hashes(), []
    for batch in batches:
        items += [(item, [hashes[w] for w in words_of(text)]) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    if items:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build(items), 5)], pa.binary())], ["index"])


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def _searcher(shards: list):
    def look(docs: list, flat, ends: list) -> pa.RecordBatch:
        import numpy as np

        found: set[tuple[int, int]] = set()
        for shard in shards:
            found |= search(pickle.loads(shard.value) if len(shards) > 1 else kept(shard), np.frombuffer(flat, "int64"), ends)
            if len(shards) > 1:
                # the worker keeps no more than one shard
                shard.__dict__.pop("_value", None)
        return pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], schema=_FOUND)

    memory: list = []

    def kept(shard) -> dict:
        if not memory:
            memory.append(pickle.loads(shard.value))
        return memory[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        hashes = Hashes()
        docs, flat, ends = [], array.array("q"), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                flat.extend(map(hashes.__getitem__, words_of(text.as_py())))
                docs.append(doc_id.as_py())
                ends.append(len(flat))
                if len(flat) >= WORDS_AT_ONCE:
                    yield look(docs, flat, ends)
                    docs, flat, ends = [], array.array("q"), []
        if docs:
            yield look(docs, flat, ends)

    return run


def leaks(documents: DataFrame, items: DataFrame, items_a_shard: int = ITEMS_A_SHARD) -> DataFrame:
    """doc_id and item_id of each document that holds a passage of an item.

    The shards of the index go through the driver one at a time; the corpus never leaves the executors.
    """
    context = documents.sparkSession.sparkContext
    source = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    asked = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    shards = max(1, -(-asked.count() // items_a_shard))
    placed = asked.withColumn("_s", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))).repartition(shards, "_s").select("item_id", "text")
    indexes = [context.broadcast(bytes(row["index"])) for row in placed.mapInArrow(_indexer, "index binary").toLocalIterator()]
    return source.mapInArrow(_searcher(indexes), "doc_id long, item_id long").distinct()
