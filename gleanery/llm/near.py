"""Records that share most of their terms, found exactly.

Records with the same set of terms form a class; classes are compared by their
smallest record. Two sets whose Jaccard similarity reaches the threshold share a
term among the rarest of each (prefix filtering), so candidates are compared
within the blocks of their rare terms only.

Within a block the comparison is bit-sliced. Each set has a sketch of ``BITS``
bits, the parity of its terms hashed to bit positions: two sketches differ in no
more bits than the sets differ in terms, and sets above the threshold differ in
at most (1 - t) / (1 + t) of their sizes' sum. The sketches of a block are
stored as bit planes, 64 records a word, where small blocks share a word; the
distances of all of them to many queries are counted at once by carry-save adders
on whole words, and a query leaves a block as soon as all its distances exceed
their radius. The filter loses no pair; a pair is taken in the block of its rarest common term
only, and survivors are verified on the terms themselves. In blocks of more than
one chunk, where a family of near copies makes many pairs, that is done in place
on 64-bit hashes of the terms, so no pair carries its terms through a shuffle.

Blocks larger than ``CHUNK`` are split into pairs of chunks, so no task holds an
unbounded block. Pairs of equal sets come from the classes.

Defined cases: null and empty arrays and arrays of nulls only have no pairs;
null terms are left out and a term given twice counts once; repeated rows of a
record count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import cut, free, join_counted

THRESHOLD = 0.8
#: Width of a sketch; a multiple of 64.
BITS = 256
#: Records of a block that are compared in one unit of work.
CHUNK = 1024
#: Queries whose distances are counted together, and planes between two looks at the radius.
QUERIES, PLANES = 256, 32


def term_sets(records: DataFrame) -> DataFrame:
    """doc_id and terms (sorted, distinct, at least one) of each record."""
    terms = F.array_sort(F.array_distinct(F.filter("words", lambda w: w.isNotNull())))
    once = records.select("doc_id", terms.alias("terms")).filter("doc_id is not null and size(terms) > 0")
    return once.groupBy("doc_id").agg(F.first("terms").alias("terms"))


def classes(sets: DataFrame) -> DataFrame:
    """doc_id and rep of each record: the smallest doc_id with the same set."""
    keyed = cut(sets.select("doc_id", F.md5(F.to_json(F.struct("terms"))).alias("_key")))
    firsts = cut(keyed.groupBy("_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")))
    return join_counted(keyed, firsts, ["_key"], "_n", keyed.count()).select("doc_id", "rep")


def _prefixes(reps: DataFrame, threshold: float) -> DataFrame:
    """token, doc_id, size, sketch and before: one row for each rare term of each class that other classes have too.

    ``before`` holds the class's rarer terms of these, in the order of all classes.
    """
    exploded = cut(reps.select("doc_id", F.size("terms").alias("size"), F.explode("terms").alias("term")).withColumn("token", F.xxhash64("term")).drop("term"))
    frequency = cut(exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    bit = F.expr(f"pmod(shiftright(token, 8), {BITS})")
    words = [F.bit_xor(F.when(F.floor(bit / 64) == w, F.expr(f"shiftleft(1L, cast(pmod(shiftright(token, 8), {BITS}) % 64 as int))")).otherwise(F.lit(0).cast("long"))) for w in range(BITS // 64)]
    sketches = exploded.groupBy("doc_id").agg(F.first("size").alias("size"), F.array(*words).alias("sketch"))
    counted = join_counted(exploded.select("doc_id", "token"), frequency, ["token"], "df", exploded.count())
    ranked = counted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_t"))
    t = Fraction(threshold).limit_denominator(10_000)
    keep = F.size("_t") - F.expr(f"cast((size(_t) * {t.numerator} + {t.denominator - 1}) div {t.denominator} as int)") + 1
    rare = ranked.withColumn("_t", F.slice("_t", F.lit(1), keep)).join(sketches, "doc_id")
    shared = rare.select("doc_id", "size", "sketch", F.transform(F.filter("_t", lambda x: x["df"] > 1), lambda x: x["token"]).alias("_s"))
    entries = shared.select("doc_id", "size", "sketch", "_s", F.posexplode("_s").alias("_at", "token"))
    return entries.select("token", "doc_id", "size", "sketch", F.slice("_s", F.lit(1), F.col("_at")).alias("before"))


def _units(entries: DataFrame, reps: DataFrame) -> DataFrame:
    """token, first, second, side and the columns of ``entries``: the units of work, pairs of chunks of each block.

    A record goes to one chunk by its hash, and with it to each unit of that chunk.
    Only in blocks of more than one chunk does it bring all its terms.
    """
    sizes = cut(entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    placed = join_counted(entries, sizes, ["token"], "n", max(entries.count(), 1))
    hashes = reps.select("doc_id", F.transform("terms", lambda t: F.xxhash64(t)).alias("terms"))
    small = placed.filter(F.col("n") <= CHUNK).withColumn("terms", F.array().cast("array<long>"))
    placed = small.unionByName(placed.filter(F.col("n") > CHUNK).join(hashes, "doc_id"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = placed.withColumn("_c", chunks).withColumn("_i", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("_c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda j: F.struct(F.least(F.col("_i"), j).alias("first"), F.greatest(F.col("_i"), j).alias("second")))
    return own.select("token", "doc_id", "size", "sketch", "before", "terms", F.col("_i").alias("chunk"), F.explode(pairs).alias("_u")).select("token", "_u.first", "_u.second", "chunk", "doc_id", "size", "sketch", "before", "terms")


def _planes(sketch):
    """Bit planes of sketches: planes[bit, word] holds that bit of 64 records; the last word is filled up with zeros."""
    import numpy as np

    n, width = sketch.shape
    words = -(-n // 64)
    padded = np.zeros((words * 64, width), "uint64")
    padded[:n] = sketch
    bits = np.unpackbits(padded.view("uint8").reshape(words * 64, -1), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T).reshape(width * 64, words, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("uint64").reshape(width * 64, words)


def _close(plane, asked, radius, lanes):
    """Queries with any distance within its radius, and for each the words of ``lanes`` whose bits tell which.

    ``plane(bit, queries)`` are the words that the queries meet, ``asked`` the
    queries' bits, ``radius`` and ``lanes`` (records that count) one entry for each query and word.
    """
    import numpy as np

    width = asked.shape[1]
    levels = width.bit_length()
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(asked))
    # a larger radius than the counters hold admits every distance
    radius = np.minimum(radius, 2**levels - 1)
    counter = [np.zeros(radius.shape, "uint64") for _ in range(levels)]
    near = lanes
    for low in range(0, width, PLANES):
        for bit in range(low, low + PLANES, 2):
            # two planes enter at once: a full adder on the lowest counter, a carry upwards
            a = plane(bit, live) ^ np.where(asked[live, bit], every, np.uint64(0))[:, None]
            b = plane(bit + 1, live) ^ np.where(asked[live, bit + 1], every, np.uint64(0))[:, None]
            half = a ^ b
            carry = (a & b) | (half & counter[0])
            counter[0] ^= half
            for level in range(1, levels):
                carry, counter[level] = carry & counter[level], counter[level] ^ carry
                if level > 5 and not carry.any():
                    break
        # compare every counter with its radius, from the highest bit down
        above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], every)
        for level in range(levels - 1, -1, -1):
            bound = np.where((radius >> level) & 1, every, np.uint64(0))
            above |= equal & counter[level] & ~bound
            equal &= ~(counter[level] ^ bound)
        near = ~above & lanes
        hold = near.any(axis=1)
        if not hold.all():
            live, near, radius, lanes = live[hold], near[hold], radius[hold], lanes[hold]
            counter = [c[hold] for c in counter]
        if not len(live):
            break
    return live, near


def _bits(words):
    """The bits of 64-bit words, one row a query."""
    import numpy as np

    return np.unpackbits(np.ascontiguousarray(words).view("uint8").reshape(len(words), -1), axis=1, bitorder="little")


def within_radius(sketch, size, queries, query_size, share):
    """Pairs (query row, record row) whose sketches differ in at most ``share`` of the sizes' sum.

    ``sketch`` and ``queries`` are arrays of 64-bit words, one row a record.
    """
    import numpy as np

    sketch, queries = np.ascontiguousarray(sketch), np.ascontiguousarray(queries)
    n = len(sketch)
    order = np.argsort(size, kind="stable")
    planes = _planes(sketch[order])
    words = planes.shape[1]
    largest = np.array([size[order][min(n, (w + 1) * 64) - 1] for w in range(words)])
    out = []
    for start in range(0, len(queries), QUERIES):
        some = slice(start, start + QUERIES)
        radius = np.floor((query_size[some][:, None] + largest[None, :]) * share + 1e-9).astype("int64")
        lanes = np.full(radius.shape, 0xFFFFFFFFFFFFFFFF, "uint64")
        live, near = _close(lambda bit, live: planes[bit][None, :], _bits(queries[some]), radius, lanes)
        if len(live):
            q, r = np.nonzero(_bits(near)[:, :n])
            out.append(np.stack([live[q] + start, order[r]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), "int64")


def within_words(sketch, size, begins, lengths, share):
    """Pairs of rows (first < second) of blocks of at most 64 rows, packed several to a word; each row meets its own word only."""
    import numpy as np

    found = []
    for n in np.unique(lengths):
        if n < 2:
            continue
        at, room = begins[lengths == n], 64 // n
        for low in range(0, len(at), room * 400):
            block = at[low : low + room * 400]
            rows = block[:, None] + np.arange(n)
            # block k of a word has the lanes from k * n on
            word, lane = np.arange(len(block)) // room, (np.arange(len(block)) % room)[:, None] * n + np.arange(n)
            placed = np.zeros(((word[-1] + 1) * 64, sketch.shape[1]), "uint64")
            placed[(word[:, None] * 64 + lane).ravel()] = sketch[rows.ravel()]
            planes = _planes(placed)
            own = np.repeat(word, n)
            later = np.array([(1 << int(n)) - (1 << (k + 1)) for k in range(n)], "uint64")
            lanes = (later[None, :] << lane[:, :1].astype("uint64")).ravel()[:, None]
            largest = np.repeat(size[rows].max(axis=1), n)
            radius = np.floor((size[rows.ravel()] + largest) * share + 1e-9).astype("int64")[:, None]
            live, near = _close(lambda bit, live: planes[bit][own[live]][:, None], _bits(sketch[rows.ravel()]), radius, lanes)
            if len(live):
                q, at_lane = np.nonzero(_bits(near))
                q = live[q]
                found.append(np.stack([rows.ravel()[q], rows[q // n, at_lane - lane[q // n, 0]]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), "int64")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


def common_terms(starts, ends, terms, q, r):
    """Number of terms that the records of each pair share; for blocks where many pairs are near.

    Products of incidence matrices, a slice of the terms at a time; terms of a single record are left out.
    """
    import numpy as np

    one, at_one = np.unique(q, return_inverse=True)
    two, at_two = np.unique(r, return_inverse=True)
    records = np.unique(np.concatenate([one, two]))
    owner = np.repeat(records, ends[records] - starts[records])
    held = np.concatenate([terms[starts[x] : ends[x]] for x in records])
    _, column, times = np.unique(held, return_inverse=True, return_counts=True)
    kept = times[column] > 1
    column = np.unique(column[kept], return_inverse=True)[1]
    owner = owner[kept]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(one), len(two)), "float32")
    width = int(column.max(initial=-1)) + 1
    for low in range(0, width, 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        who, what = owner[part], column[part] - low
        sides = []
        for side in (one, two):
            place = np.minimum(np.searchsorted(side, who), len(side) - 1)
            mine = side[place] == who
            matrix = np.zeros((len(side), 4096), "float32")
            matrix[place[mine], what[mine]] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    return total[at_one, at_two].astype("int64")


def _comparer(threshold: float):
    share = (1 - threshold) / (1 + threshold)
    exact = Fraction(threshold).limit_denominator(10_000)
    above, below = exact.numerator, exact.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def met_before(starts, ends, tokens, q, r):
            """Whether the pairs share a rarer term, in whose block they are found."""
            out = np.zeros(len(q), bool)
            for low in range(0, len(q), 100_000):
                x, y = q[low : low + 100_000], r[low : low + 100_000]
                nx, ny = ends[x] - starts[x], ends[y] - starts[y]
                met = np.zeros(len(x), bool)
                for i in range(int(nx.max(initial=0))):
                    for j in range(int(ny.max(initial=0))):
                        at = np.flatnonzero((i < nx) & (j < ny) & ~met)
                        met[at[tokens[starts[x[at]] + i] == tokens[starts[y[at]] + j]]] = True
                out[low : low + 100_000] = met
            return out

        def found(doc, size, starts, ends, tokens, q, r, terms=None):
            """Of pairs of rows within the radius those of similar sizes that no other block has; sure ones with ``terms``."""
            small, large = np.minimum(size[q], size[r]), np.maximum(size[q], size[r])
            ok = (doc[q] != doc[r]) & (small >= threshold * large - 1e-9)
            q, r = q[ok], r[ok]
            new = ~met_before(starts, ends, tokens, q, r)
            q, r = q[new], r[new]
            if terms is not None and len(q):
                common = common_terms(*terms, q, r)
                alike = common * below >= (size[q] + size[r] - common) * above
                q, r = q[alike], r[alike]
            a, b = doc[q], doc[r]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), terms is not None))], schema=_PAIRS)

        def one_by_one(size, sketch, q, r):
            """Of the pairs those within their own radius, which may be less than their word's."""
            apart = np.bitwise_count(sketch[q] ^ sketch[r]).sum(axis=1)
            near = apart <= np.floor((size[q] + size[r]) * share + 1e-9)
            return q[near], r[near]

        def lists_of(column):
            lists = column.combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = lists.offsets.to_numpy()
            return offsets[:-1], offsets[1:], lists.values.to_numpy()

        def units(table, bounds):
            table = table.combine_chunks()
            first, second, chunk, doc, size = (table.column(i).to_numpy() for i in range(1, 6))
            sketch = table.column(6).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).view("uint64")
            starts, ends, tokens = lists_of(table.column(7))
            terms = lists_of(table.column(8))
            begins, lengths = bounds[:-1], np.diff(bounds)
            whole = first[begins] == second[begins]
            # blocks that fit into one word share it with others
            few = whole & (lengths <= 64)
            q, r = within_words(sketch, size, begins[few], lengths[few], share).T
            for low in range(0, len(q), 500_000):
                yield from found(doc, size, starts, ends, tokens, *one_by_one(size, sketch, q[low : low + 500_000], r[low : low + 500_000]))
            for s, n, same in zip(begins[~few], lengths[~few], whole[~few]):
                rows = np.arange(s, s + n)
                one = rows if same else rows[chunk[rows] == first[s]]
                two = rows if same else rows[chunk[rows] == second[s]]
                if not len(one) or not len(two):
                    continue
                q, r = within_radius(sketch[two], size[two], sketch[one], size[one], share).T
                q, r = one[q], two[r]
                if same:
                    q, r = q[q < r], r[q < r]
                whole_terms = terms if terms[1][s] > terms[0][s] else None
                yield from found(doc, size, starts, ends, tokens, q, r, whole_terms)

        # units come whole and in order; the last of a batch may go on in the next
        rest = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            table = here if rest is None else pa.concat_tables([rest, here])
            token, first, second = (table.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((token[1:] != token[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
            if len(change):
                yield from units(table.slice(0, change[-1]), np.concatenate([[0], change]))
                table = table.slice(change[-1])
            rest = table
        if rest is not None and rest.num_rows:
            yield from units(rest, np.array([0, rest.num_rows]))

    return compare


def class_pairs(sets: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (a < b): classes, by their smallest records, whose sets are similar but not equal."""
    reps = cut(sets.join(members.filter("doc_id = rep").select("doc_id"), "doc_id"))
    units = _units(cut(_prefixes(reps, threshold)), reps)
    ordered = units.repartition("token", "first", "second").sortWithinPartitions("token", "first", "second")
    found = cut(ordered.select("token", "first", "second", "chunk", "doc_id", "size", "sketch", "before", "terms").mapInArrow(_comparer(threshold), "a long, b long, sure boolean"))
    sure = found.filter("sure").select("a", "b")
    left = found.filter("not sure").select("a", "b").join(reps.select(F.col("doc_id").alias("a"), F.col("terms").alias("_x")), "a")
    both = left.join(reps.select(F.col("doc_id").alias("b"), F.col("terms").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    t = Fraction(threshold).limit_denominator(10_000)
    alike = common * t.denominator >= (F.size("_x") + F.size("_y") - common) * t.numerator
    return both.filter(alike).select("a", "b").unionByName(sure)


def similar_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id_a and doc_id_b (a < b) of all records whose similarity reaches the threshold."""
    sets = cut(term_sets(records))
    members = cut(classes(sets))
    pairs = cut(class_pairs(sets, members, threshold))
    sizes = cut(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    # members of a class are spread over chunks, so no class is one key; a link meets each chunk of either side
    spread = cut(join_counted(members, sizes, ["rep"], "n", max(members.count(), 1)).select("rep", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), chunks).cast("int").alias("k")))
    links = pairs.unionByName(sizes.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    parts = sizes.select("rep", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("k"))
    for side in ("a", "b"):
        links = links.join(parts.select(F.col("rep").alias(side), F.col("k").alias(f"_{side}")), side)
    two = links.join(spread.select(F.col("rep").alias("b"), F.col("k").alias("_b"), F.col("doc_id").alias("_two")), ["b", "_b"])
    named = two.join(spread.select(F.col("rep").alias("a"), F.col("k").alias("_a"), F.col("doc_id").alias("_one")), ["a", "_a"])
    named = named.filter((F.col("a") != F.col("b")) | (F.col("_one") < F.col("_two")))
    return named.select(F.least("_one", "_two").alias("doc_id_a"), F.greatest("_one", "_two").alias("doc_id_b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and label: the smallest node that edges (a, b) connect it to.

    Alternating large-star and small-star rounds halve the depth of every tree;
    the loop ends when a round changes no edge.
    """
    stars = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct())
    spent = None
    while True:
        both = cut(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # a star's centre has as many edges as it has neighbours: the counts tell the hot ones
        root = cut(both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "_m").alias("m"), "_n"))
        large = cut(join_counted(both, root, ["u"], "_n", max(both.count(), 1)).filter("v > u").select(F.col("m").alias("u"), "v").distinct())
        low = cut(large.groupBy("v").agg(F.min("u").alias("_m"), F.count(F.lit(1)).alias("_n")))
        small = join_counted(large, low, ["v"], "_n", max(large.count(), 1)).select("_m", "u", "v")
        nxt = cut(small.select(F.col("_m").alias("u"), "v").unionByName(small.filter("u <> _m").select(F.col("_m").alias("u"), F.col("u").alias("v"))).distinct(), replaces=spent)
        for used in (both, root, large, low):
            free(used)
        if nxt.exceptAll(stars).isEmpty() and stars.exceptAll(nxt).isEmpty():
            break
        spent, stars = stars, nxt
    return nodes.select("node").join(stars.select(F.col("v").alias("node"), F.col("u").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def groups(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest record of an equal set), group_id (smallest connected record) and links (similar classes)."""
    sets = cut(term_sets(records))
    members = cut(classes(sets))
    pairs = cut(class_pairs(sets, members, threshold))
    label = components(members.filter("doc_id = rep").select(F.col("rep").alias("node")), pairs)
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    reps = label.join(ends, label["node"] == ends["a"], "left").select(F.col("node").alias("rep"), F.col("label").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    counted = reps.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")), "rep")
    return join_counted(members, cut(counted), ["rep"], "_n", max(members.count(), 1)).select("doc_id", F.col("rep").alias("class_id"), "group_id", "links")
