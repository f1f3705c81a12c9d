"""Text operators against brute force and on awkward inputs."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import boilerplate, capping, distinctive, leaks, leximin, lines, near, residue, stuffing, tokens

PAGE = "doc_id long, url string, title string, content_text string, html_text string"
PROFILE = "doc_id long, url string, domain string, inbound_link_count long, outbound_link_count long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pages(spark, texts, titles=None, html=None):
    return spark.createDataFrame([(i, f"http://h.org/{i}", (titles or {}).get(i), t, (html or {}).get(i)) for i, t in enumerate(texts)], PAGE)


def profile(spark, n, domain="h.org"):
    return spark.createDataFrame([(i, f"http://h.org/{i}", domain, 1, 1) for i in range(n)], PROFILE)


# --- lines


def test_repeated_lines(spark):
    texts = ["Über UNS 1\r\nown a\n\n!!!", "über uns\nown b\nüber uns", "ÜBER  uns!\n12", "(über-uns)\nown c", "über uns 5\nStraße", None, "", "  ", "überuns\nSTRASSE"]
    p = pages(spark, texts)
    p = p.unionByName(p.filter("doc_id = 1"))
    found = rows(lines.repeated_lines(p, profile(spark, 9)).select("doc_id", "line_no"))
    assert found == [(0, 1), (1, 1), (1, 3), (2, 1), (3, 1), (4, 1)]
    assert rows(lines.repeated_lines(p, profile(spark, 9), min_support=6)) == []
    assert (4, 2) in rows(lines.repeated_lines(p, profile(spark, 9), min_support=2).select("doc_id", "line_no"))
    clean = {r.doc_id: r.content_text for r in lines.without_repeated_lines(p, profile(spark, 9)).collect()}
    assert clean[1] == "own b" and clean[5] is None and clean[6] == "" and len(clean) == 9
    other = profile(spark, 4).unionByName(spark.createDataFrame([(4, "http://www.x.org:80/", "unknown", None, None)], PROFILE))
    assert rows(lines.repeated_lines(p.filter("doc_id < 5"), other)) == []


def test_frequent_sequences(spark):
    texts = [f"menu one\n\nmenu two\nmenu three\nown {'abcdef'[i]}\nfoot" for i in range(5)] + ["menu two\nmenu one"]
    table, links = pages(spark, texts), profile(spark, 6)
    got = lines.frequent_sequences(table, links).select("length", "support", "doc_id", "first_line", "last_line")
    # the third line and the last always follow each other, across a document's own line; the pair in the other order has one document
    assert rows(got) == [(1, 6, 0, 1, 1), (1, 6, 0, 3, 3), (2, 5, 0, 1, 3), (2, 5, 0, 4, 6), (3, 5, 0, 3, 6), (4, 5, 0, 1, 6)]
    assert rows(lines.deleted_lines(table, links)) == rows(lines.repeated_lines(table, links).select("doc_id", "line_no"))


@pytest.mark.parametrize("seed", [1, 2])
def test_sequences_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "abcdefgh"
    docs = []
    for _ in range(40):
        start, out = rng.randrange(4), []
        for w in (words[start:] if rng.random() < 0.7 else rng.sample(words, 5)):
            out += [f"line {w}"] * (rng.random() < 0.9) + [f"own {''.join(rng.choices('xyz', k=9))}"] * (rng.random() < 0.3) + [""] * (rng.random() < 0.2)
        docs.append(out)
    support = {}
    for d in docs:
        for x in set(d) - {""}:
            support[x] = support.get(x, 0) + 1
    reduced = [[x for x in d if support.get(x, 0) >= 5] for d in docs]
    want = {}
    for d in reduced:
        for run in {tuple(d[i:j]) for i in range(len(d)) for j in range(i + 1, len(d) + 1)}:
            want[run] = want.get(run, 0) + 1
    want = {run: n for run, n in want.items() if n >= 5}
    got = {}
    for r in lines.frequent_sequences(pages(spark, ["\n".join(d) for d in docs]), profile(spark, 40)).collect():
        run = tuple(x for x in docs[r.doc_id][r.first_line - 1 : r.last_line] if support.get(x, 0) >= 5)
        got[run] = r.support
        assert len(run) == r.length
    assert got.items() <= want.items()
    # what is left out lies within a longer sequence of as many documents: a block is cut in it
    for run in set(want) - set(got):
        longer = [w for w in got if len(w) > len(run) and any(w[i : i + len(run)] == run for i in range(len(w) - len(run) + 1))]
        assert any(got[w] >= want[run] for w in longer)


def test_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(lines, "LENGTHS", 4)
    block = "\n".join(f"menu {'abcdefghi'[i]}" for i in range(9))
    texts = [f"{block}\nown {'abcde'[i]}" for i in range(5)]
    got = lines.frequent_sequences(pages(spark, texts), profile(spark, 5)).groupBy("length").agg(F.count("*"), F.min("support"))
    # lines that always stand together are one block
    assert rows(got) == [(9, 1, 5)]
    # menus that stand in part on some pages make a step for each block
    parts = [f"{block}\nown {'abcde'[i]}" for i in range(5)] + [f"menu {x}" for x in "abcdefghi"]
    got = lines.frequent_sequences(pages(spark, parts), profile(spark, 14)).groupBy("length").agg(F.count("*"), F.max("support"))
    assert rows(got) == [(1, 9, 6)] + [(n, 10 - n, 5) for n in range(2, 10)]


# --- main body

ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body><div class=menu><p>Home<p>Shop</div>
<div><h1>The  long <b>walk</b></h1><div>By Ann Lee, May 3</div><p>We walked for a long time through the quiet valley.<p>Then it rained and we went home.<li>3 x tin cups</li><div>Share this page (4)</div><p>&quot;It was fine&quot;, said Ann &amp; Bob.</div>
<div><p>Read next<p>Another story here<p>A teaser that runs on like a sentence does, for a while.</div></body></html>"""
BODY = ["Home", "Shop", "The  long walk", "By Ann Lee, May 3", "We walked for a long time through the quiet valley.", "Then it rained and we went home.", "3 x tin cups", "Share this page (4)", '"It was fine", said Ann & Bob.', "Read next", "Another story here", "A teaser that runs on like a sentence does, for a while."]


def test_main_body(spark):
    texts = ["\n".join(BODY)] * 2 + [None, "", "\n \n", "one line"]
    p = pages(spark, texts, {0: "The long walk", 1: "The  long walk"}, {0: ARTICLE})
    p = p.unionByName(p)
    out = {}
    for r in boilerplate.not_main_lines(p, profile(spark, 6)).collect():
        out.setdefault(r.doc_id, []).append(r.line_no)
    assert sorted(out[0]) == [1, 2, 4, 8, 10, 11, 12]
    assert {4, 8, 10} <= set(out[1]) and not {3, 5, 6, 7, 9} & set(out[1])
    assert set(out) == {0, 1}
    text = {r.doc_id: r.main_text for r in boilerplate.main_text(p, profile(spark, 6)).collect()}
    assert text[5] == "one line" and text[3] == "" and 2 not in text and text[0].startswith("The  long walk\nWe walked")


def test_lines_aligned_over_the_whole_page():
    hidden = [f"option {i}" for i in range(50)]
    parts = ["top", *hidden, "a", "x", "b", "x", "c", "foot"]
    assert boilerplate.aligned(["top", "a", "x", "not there", "b", "x", "foot"], parts) == [0, 51, 52, -1, 53, 54, 56]
    assert boilerplate.aligned(["x", "foot", "x"], parts) == [52, 56, -1] and boilerplate.aligned(["a"], []) == [-1]
    # hidden markup before the text, a long legal line, a long pointer
    assert boilerplate.line_kind("© 2020 Zorb " + "and others " * 40) == 2 and boilerplate.line_kind("Read next: " + "a long way " * 30) == 1
    assert boilerplate.line_kind("By the river stood a house, and by the house a tree that nobody had planted.") == 0


def test_surge(spark):
    """A stretch whose windows stay short is no text, however many lines it has."""
    menu = "".join(f"<p>m{i}</p>" for i in range(30))
    html = f"<div>{menu}</div><div><p>{'word ' * 30}</p></div>"
    text = "\n".join([f"m{i}" for i in range(30)] + ["word " * 30])
    found = boilerplate.not_main_lines(pages(spark, [text], {}, {0: html}), profile(spark, 1))
    assert sorted(r.line_no for r in found.collect()) == list(range(1, 31))


def test_stripped():
    got = boilerplate.stripped("<div><p>a<p>b<b>c</b></div><!-- x --><script>var q='<p>no</p>'</script><div><div>d</div><div>e</div><ul><li>f</ul></div>g<br>h<")
    assert [t for t, _, _ in got] == ["a", "bc", "d", "e", "f", "g", "h<"]
    where = [w for _, w, _ in got]
    assert where[0] == where[1] != where[2] and where[2] == where[3] == where[4] != where[5] == where[6]
    assert boilerplate.stripped("") == [] and boilerplate.stripped("<>") == [("<>", 0, False)]


# --- stuffing


def prose(rng, n=12):
    nouns = "bridge garden river market engine window valley tunnel ladder basket".split()
    return "\n".join(f"The {rng.choice(nouns)} of the town is near the {rng.choice(nouns)}, and it was there when we came to see {rng.choice(nouns)} and {rng.choice(nouns)}." for _ in range(n))


def test_stuffed_pages(spark):
    rng = random.Random(1)
    spam = [" ".join(f"cheap zorbit lamp {x}" for x in "abcdefghij" * 6), "\n".join(f"Zorb{i} deals - http://z{i}.org/x" for i in range(40)), " ".join(rng.choice(["#vap", "#zil", "#mek"]) for _ in range(120))]
    lists = ["The list of the things that we have in the house and it is all there for you to see.\n" + "\n".join(f"{i} kg item{chr(97 + i)} xolo" for i in range(20))]
    texts = [prose(rng, n) for n in range(6, 26)] + spam + lists + [None, "", " ", "12 34"]
    found = [r.doc_id for r in stuffing.stuffed_pages(pages(spark, texts), profile(spark, len(texts))).collect()]
    assert sorted(found) == [20, 21, 22]
    assert stuffing.stuffed_pages(pages(spark, texts[20:23]), profile(spark, 3)).count() == 3


def written(rng, function, tag, n):
    """Lines of running text: function words and invented others, each as often as its rank tells."""
    content = [f"{tag}{''.join(rng.choices('aeioulrnt', k=5))}" for _ in range(400)]
    weigh = lambda words: [1 / (k + 1) for k in range(len(words))]
    line = lambda: " ".join(rng.choices(function, weigh(function))[0] if rng.random() < 0.45 else rng.choices(content, weigh(content))[0] for _ in range(rng.randrange(9, 15)))
    return ["\n".join(line().capitalize() + "." for _ in range(k)) for k in n]


def test_stuffing_in_a_language_without_a_list(spark):
    """The curve decides: by sentences of known languages all pages of the fifth would be cases."""
    rng = random.Random(5)
    lengths = [rng.randrange(8, 30) for _ in range(60)]
    english = written(rng, "the of and to in is that it was for on are with as they at".split(), "en", lengths)
    italian = written(rng, "di che il non della sono gli per una più nel anche dei questo alla ogni".split(), "it", lengths)
    spam = ["\n".join(f"Zorb{i} Lampada{i} Offerta{i}" for i in range(40)), " ".join(f"lampada {x}zor" for x in "abcdefghij" * 6), " ".join(rng.choice(["#vap", "#zil", "#mek"]) for _ in range(120))]
    spam[0] = "\n".join(f"{''.join(rng.choices('bcdfghk', k=6))} {''.join(rng.choices('bcdfghk', k=6))} offerta" for i in range(40))
    texts = english + italian + spam
    rows = {r.doc_id: r for r in stuffing.judged(pages(spark, texts), profile(spark, len(texts))).collect()}
    assert {i for i, r in rows.items() if r.stuffed} == {120, 121, 122}
    assert all(rows[i].prose < stuffing.PROSE_LEAST for i in range(60, 123))


# --- distinctive terms


def test_log_likelihood(spark):
    docs = [(1, ["a", "a", "b", None]), (2, ["b", "c", ""]), (3, []), (4, None), (5, ["b"] * 50), (1, ["a", "a", "b", None])]
    df = spark.createDataFrame(docs, "doc_id long, words array<string>")
    got = {(r.doc_id, r.term): (r.tf, r.doc_freq, r.score) for r in distinctive.distinctive_terms(df).collect()}
    counts = {1: {"a": 2, "b": 1}, 2: {"b": 1, "c": 1, "": 1}, 5: {"b": 50}}
    total = 56
    term = {"a": 2, "b": 52, "c": 1, "": 1}

    def ratio(a, b, c, d):
        n, g = a + b + c + d, 0
        for o, e in ((a, (a + b) * (a + c) / n), (b, (a + b) * (b + d) / n), (c, (c + d) * (a + c) / n), (d, (c + d) * (b + d) / n)):
            g += 2 * o * math.log(o / e) if o else 0
        return g if a * (b + d) >= b * (a + c) else -g

    assert set(got) == {(d, t) for d, ts in counts.items() for t in ts}
    for (d, t), (tf, df_, score) in got.items():
        size = sum(counts[d].values())
        assert tf == counts[d][t] and df_ == sum(t in c for c in counts.values())
        assert score == pytest.approx(ratio(tf, term[t] - tf, size - tf, total - size - term[t] + tf), abs=1e-9)
    assert got[(1, "a")][2] > got[(1, "b")][2] and got[(1, "b")][2] < 0
    assert distinctive.distinctive_terms(df.filter("doc_id = 5")).first().score == 0


# --- capping


def capped(records, limit):
    by = {}
    for doc, site, score in dict.fromkeys(records):
        s = 0.5 if score is None or score != score else max(-1e300, min(1e300, score))
        by.setdefault(site, {})[doc] = s
    return sorted(d for site in by.values() for d, _ in sorted(site.items(), key=lambda x: (-x[1], x[0]))[limit:])


@pytest.mark.parametrize("seed", range(3))
def test_capping(spark, seed):
    rng = random.Random(seed)
    scores = [None, float("nan"), float("inf"), -float("inf"), 0.5, 0.1, 1e-320, 5e-324] + [rng.random() for _ in range(20)] + [round(rng.random(), 1) for _ in range(10)]
    data = [(i * rng.choice([1, 1, 7]) if seed else i, rng.choice(["hot", "hot", "b", "c", None, "rare" + str(i)]), rng.choice(scores)) for i in range(400)]
    seen = set()
    data = [d for d in data if not (d[0] in seen or seen.add(d[0]))]
    df = spark.createDataFrame(data + data[:20], "doc_id long, site string, score double")
    for limit in (1, 7, 60):
        assert sorted(r.doc_id for r in capping.over_limit(df, "site", most=limit).collect()) == capped(data, limit)
    limit = max(1, int(len(data) * 0.1))
    assert sorted(r.doc_id for r in capping.over_limit(df, "site", share=0.1).collect()) == capped(data, limit)


def test_capping_by_key(spark, monkeypatch):
    monkeypatch.setattr(capping, "BROADCAST_ROWS", 0)
    data = [(i, "s" + str(i % 3), (i % 5) / 10) for i in range(60)]
    assert sorted(r.doc_id for r in capping.over_limit(spark.createDataFrame(data, "doc_id long, site string, score double"), "site", most=4).collect()) == capped(data, 4)
    assert capping.over_limit(spark.createDataFrame([], "doc_id long, site string, score double"), "site", share=0.5).count() == 0


# --- near duplicates


def families(rng, n):
    vocabulary = [f"t{i}" for i in range(400)]
    out, base = [], rng.sample(vocabulary, 60)
    for i in range(n):
        if i % 3 == 0:  # a third of all records are variants of one
            words = base[:]
        elif i % 3 == 1:
            words = rng.sample(vocabulary, rng.randrange(1, 60))
        else:
            words = list(out[rng.randrange(len(out))]) or ["t1"]
        for _ in range(rng.randrange(0, 5)):
            if len(words) > 3:
                words.pop(rng.randrange(len(words)))
            words.append(rng.choice(vocabulary))
        rng.shuffle(words)
        out.append(words)
    return out


def brute(sets):
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("chunk", [1024, 40])
def test_similar_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(near, "CHUNK", chunk)
    words = families(random.Random(chunk), 300)
    data = [(i, w) for i, w in enumerate(words)] + [(900, []), (901, None), (902, [None]), (903, ["x", None, "x"]), (904, ["x"]), (0, words[0])]
    df = spark.createDataFrame(data, "doc_id long, words array<string>")
    sets = {i: set(w) - {None} for i, w in data if w and set(w) - {None}}
    got = [tuple(r) for r in near.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and sorted(got) == brute(sets)
    # groups are the components of those pairs
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(sets):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = {r.doc_id: (r.class_id, r.group_id) for r in near.groups(df).collect()}
    assert {i: g for i, (_, g) in groups.items()} == {i: root(i) for i in sets}
    assert all(c == min(j for j in sets if sets[j] == sets[i]) for i, (c, _) in groups.items())


def test_within_radius():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 2**63, (700, 4), dtype="uint64")
    sketch[300:600] = sketch[:300] ^ (np.uint64(1) << rng.integers(0, 63, (300, 4), dtype="uint64"))
    size = rng.integers(20, 120, 700)
    got = {tuple(x) for x in near.within_radius(sketch, size, sketch[:500], size[:500], 1 / 9)}
    apart = np.bitwise_count(sketch[:500][:, None] ^ sketch[None]).sum(2)
    want = {tuple(x) for x in np.argwhere(apart <= np.floor((size[:500][:, None] + size[None]) / 9 + 1e-9))}
    # the radius of a word of 64 records is that of its largest, so it may keep a few more but loses none
    assert want <= got and len(got) <= len(want) + 50


def test_within_words():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 65, 60)
    begins = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    base = rng.integers(0, 2**63, (n, 4), dtype="uint64")
    sketch = np.where(rng.random((n, 1)) < 0.5, base[0], base) ^ (np.uint64(1) << rng.integers(0, 63, (n, 4), dtype="uint64"))
    size = rng.integers(20, 120, n)
    got = {tuple(x) for x in near.within_words(sketch, size, begins, lengths, 1 / 9)}
    want = {(i, j) for b, k in zip(begins, lengths) for i in range(b, b + k) for j in range(i + 1, b + k) if np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= (size[i] + size[j]) // 9}
    block = np.repeat(np.arange(60), lengths)
    assert want <= got and all(i < j and block[i] == block[j] for i, j in got)


def test_large_class_of_equal_records(spark):
    """A third of all records are equal: no task holds their class, and each is placed."""
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("x"), F.col("id").cast("string")))).alias("words"))
    got = near.groups(many)
    assert got.filter("class_id = 0").count() == 10_000 and got.count() == 30_000 and got.filter("links > 0").count() == 0


def test_radius_beyond_the_counters():
    # pairs of records of 2,304 terms, and ordinary records in the word of a record of 4,600
    sketch = np.arange(40, dtype="uint64")[:, None] * np.ones((1, 4), "uint64")
    for size in np.full(40, 2304), np.array([80] * 39 + [4600]):
        apart = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(2)
        got = {tuple(x) for x in near.within_radius(sketch, size, sketch, size, 1 / 9)}
        assert {tuple(x) for x in np.argwhere(apart <= np.floor((size[:, None] + size[None]) / 9))} <= got


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (30, 31), (31, 32), (32, 30)]
    nodes = sorted({x for e in chain for x in e} | {500})
    got = dict(rows(near.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(chain, "a long, b long"))))
    assert got == {n: 0 if n <= 20 else 30 if n <= 32 else 100 if n <= 102 else 500 for n in nodes}


# --- leximin


def test_leximin(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "q", None]), i, *[rng.choice([None, float("nan"), 0.5, rng.random() * 10**k, float("inf")]) for k in range(3)]) for i in range(300)]
    df = spark.createDataFrame(data + data[:10], "q string, doc_id long, x double, y double, z double")
    got = {(r.q, r.doc_id): r.position for r in leximin.leximin_order(df, "q", ["x", "y", "z"]).collect()}
    fine = lambda v: v is not None and v == v and abs(v) != math.inf
    for q in ("hot", "q", None):
        items = [d for d in data if d[0] == q]
        columns = [[d[2 + k] for d in items if fine(d[2 + k])] for k in range(3)]
        key = {}
        for d in items:
            v = [(sum(o < d[2 + k] for o in columns[k]) + sum(o == d[2 + k] for o in columns[k]) / 2) / len(columns[k]) if fine(d[2 + k]) else 0.5 for k in range(3)]
            key[d[1]] = ([-x for x in sorted(v)], d[1])
        assert [got[(q, i)] for i in sorted(key, key=key.get)] == list(range(1, len(key) + 1))


# --- tokens

ODD = ["", None, " ", "\n\n  \t x", "don't we'LL I'm", "<|endoftext|> and <|endoftext|>", "naïve café Ünïcödé", "日本語 テキスト 12345 ٣٤", "a" * 5000, "x  y   z    ", "​﻿­", "👩‍👩‍👧 ok", "\r\n\r\n", "é é", " 　wide", "0" * 30 + " 1.5e-3", "same text", "same text"]


def test_encode(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = ODD + [" ".join(random.Random(i).choices(["alpha", "βeta", "γ", "12", "...", "\n"], k=400)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = tokens.encode(df)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in tokens.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).count() == 0


# --- leaks

ITEMS = [(1, "One two three four five six seven eight nine ten eleven."), (2, "Café déjà vu"), (3, ""), (4, None), (5, "..."), (6, "one two three four five six seven eight nine ten eleven"), (7, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich und weiter")]
TEXTS = [
    "x ONE, two; three-four five\nsix <b>sev</b>en &#101;ight n&iacute;ne te­n y",
    "cafe deja vu",
    "un café de​ja vu ici",
    "one two three four five six seven eight nine",
    "two three four five six seven eight nine ten eleven",
    None,
    "",
    "cafe deja",
    "w " * 300 + "ZWOELF zwolf boxkampfer jagen viktor quer uber den GROSSEN sylter deich" + " w" * 300,
    "one two three four five x six seven eight nine ten eleven",
]


def test_leaks(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = rows(leaks.leaks(d.unionByName(d), spark.createDataFrame(ITEMS, "item_id long, text string")))
    assert got == [(0, 1), (0, 6), (1, 2), (2, 2), (4, 1), (4, 6), (8, 7)]
    assert leaks.leaks(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("per_pass", [20_000, 7])
def test_leaks_brute_force(spark, monkeypatch, per_pass):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(vocabulary, k=rng.randrange(1, 30))) for i in range(30)]
    texts = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if i % 2:
            item = rng.choice(items)[1]
            at, n = rng.randrange(len(item)), rng.randrange(5, 15)
            where = rng.randrange(len(words) + 1)
            words[where:where] = item[at : at + n]
        texts.append(words)

    def holds(text, item):
        n = min(10, len(item))
        runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        return any(tuple(text[i : i + n]) in runs for i in range(len(text) - n + 1))

    want = sorted((d, i) for d, t in enumerate(texts) for i, it in items if holds(t, it))
    got = leaks.leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"), per_pass)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_many_items_in_small_memory():
    """The lists of a shard are sparse: their size follows the words of the items, not terms times items."""
    import pickle

    rng = random.Random(4)
    items = [(i, [rng.randrange(50_000) for _ in range(60)]) for i in range(5000)]
    index = leaks.build(items)
    assert len(pickle.dumps(index, 5)) < 60 * 5000 * 80
    text = np.array(items[17][1][5:25] + [99_999] * 40 + items[4000][1][:9] + [99_998] + items[31][1][50:60], "int64")
    assert leaks.search(index, text, [len(text)]) == {(0, 17), (0, 31)}


# --- residue

BAD = [
    "Welcome back, undefined!", "The {{ name }} is here.", "It holds ${order.id} pieces.", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "404 - Not Found\nThe page you asked for was moved or removed.", "Traceback (most recent call last):\n  File \"/a/b.py\", line 3, in f\nKeyError: 'x'",
    "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Some text that is fine.\nlamp: NaN\nMore of it.", "Your text goes here.", "\"The <%= x %> joins our pump\", wrote Ann.", "PAGE INTROUVABLE", "[INSERT city] is large", "Aquí va su texto.", "java.lang.NullPointerException\n\tat a.b.C(Main.java:3)",
]
GOOD = [
    None, "", "   ", "word", "The tag {{name}} stands for the name of the reader.", "In the template we write `${x}`, and it is filled in later.", "A reader asked why it answers with \"Page not found\" although it is there.", "for a in range(3):\n    print(b[\"c\"])", "We saw 404 trees and 503 birds.", "He said \"lorem ipsum dolor sit\" is dummy copy.",
    "See also [82] and [1].", "a <|endoftext|> b", "________ ~~~~ ====", "Back to the front page", "100% of it, 5% more", "Der Fehler lag im Garten.",
]


def test_residue(spark):
    df = spark.createDataFrame(list(enumerate(BAD + GOOD)), "doc_id long, text string")
    found = sorted(r.doc_id for r in residue.residue_documents(df.unionByName(df.filter("doc_id = 0"))).collect())
    assert [(BAD + GOOD)[i] for i in sorted(set(found) ^ set(range(len(BAD))))] == []
    assert len(found) == len(set(found))
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_templates_merge(spark):
    df = spark.createDataFrame([(i, f"You have no permission to open /a{i}/b.") for i in range(30)], "doc_id long, text string").repartition(4)
    [row] = residue.templates(residue.mined(df)).collect()
    assert row.uses == 30 and row.points == 2 and row.template.startswith("you have no permission to open")


def test_residue_of_a_leaf_with_ordinary_messages(spark):
    texts = ["The page you requested could not be found.", "The page you see was written in May.", "The site you want is down for maintenance.", "The site you want is well known there."]
    found = residue.residue_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(found) == [(0,), (2,)]


def examples(parsed):
    """Texts of a parsed pattern: every branch, repeats none and once."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            one = [chr(arg)]
        elif kind == "IN":
            one = [chr(arg[0][1])] if str(arg[0][0]) == "LITERAL" else ["a"]
        elif kind == "BRANCH":
            one = [e for branch in arg[1] for e in examples(branch)]
        elif kind == "SUBPATTERN":
            one = examples(arg[3])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            one = [""] * (arg[0] == 0) + examples(arg[2])
        else:
            one = [" "] if kind == "ANY" else [""]
        out = [a + b for a in out for b in one]
    return out


def test_every_pattern_has_a_cue():
    for pattern in residue._ERROR + residue._FAILURE + residue._FILLER + residue._AWAY:
        texts = [e for e in examples(re._parser.parse(pattern)) if re.search(pattern, e)]
        assert texts and [e for e in texts if not residue.cued(residue._WORD.findall(e))] == [], pattern


def test_a_template_has_the_verdict_of_its_messages():
    rng = random.Random(6)
    for pattern in residue._ERROR + residue._FAILURE + residue._FILLER + residue._AWAY:
        for e in examples(re._parser.parse(pattern)):
            for said in (e, f"{e} {rng.choice(['then', 'lamps', 'Error', 'page'])} gone far away", f"today we see {e}"):
                tokens = residue.masked(said)
                assert residue.verdict(residue.template_of(tokens)) == residue.verdict(" ".join(tokens)), said


def test_residue_of_any_length(spark):
    long = "x" * 300
    texts = [f"The {{{{ {long} }}}} is here.", f"“{'Page not found, they said, and ' * 20}” was all.", "bla Bla bla bla bla bla bla bla bla", "Warning: Undefined variable $x in /a/b.php on line 3", "We found bla bla in it."]
    assert rows(residue.residue_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))) == [(0,), (2,), (3,)]
