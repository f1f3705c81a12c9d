"""Token ids of a whole corpus, each distinct word encoded once.

A byte-level tokenizer splits a text into pre-tokens and encodes each by itself,
so the ids of a text are those of its pre-tokens in order. The corpus is encoded
in three steps:

1. Texts are split into pre-tokens. Each batch of documents keeps a dictionary
   of its own words and each text becomes positions in that dictionary, so the
   sequence of words is kept without one row a word.
2. The dictionaries' words meet in one shuffle that keeps each distinct word
   once. It is encoded there; the ids go back to every dictionary that holds it.
   One word comes at most once a batch, and the words of very many batches are
   joined apart by their counts, so no word is hot however often the corpus
   repeats it.
3. The dictionary of a batch, now of ids, is joined to its texts, which are
   reassembled by position.

``decode`` joins the ids to the table of the tokens' bytes, whose size is that
of the vocabulary, and concatenates them by position.

The vocabulary file is read by the driver; its bytes go to the executors, which
need no copy of the folder.

Defined cases: null and empty texts have an empty list of ids; special tokens'
strings are ordinary text; rows may repeat; texts of any length are one
sequence; a lone surrogate can't occur in a table of UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.scale import cut, join_counted

#: Where the vocabulary files are; a parameter of every function.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that share a dictionary at most.
BATCH = 1000


def ranks(file: bytes) -> dict[bytes, int]:
    """Token bytes and ids of the content of a vocabulary file."""
    rows = (line.split() for line in file.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def _splitter():
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        import regex
        from pyspark import TaskContext

        find = regex.compile(PATTERN).findall
        part, count = TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
        names = ["chunk", "doc_id", "at", "words"]
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                chunk = (part << 32) + count
                count += 1
                places: dict[str, int] = {}
                docs, ends, flat = [], [0], array.array("i")
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        words = find(text)
                        for w in words:
                            if w not in places:
                                places[w] = len(places)
                        flat.extend(map(places.__getitem__, words))
                    docs.append(doc_id)
                    ends.append(len(flat))
                at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(docs), kinds[0]), pa.array(docs, kinds[1]), at, pa.nulls(len(docs), kinds[3])], names)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), pa.array([list(places)], kinds[3])], names)

    return split


def _encoder(file):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(file.value), special_tokens={})
        single = coder._core_bpe.encode_single_piece if hasattr(coder, "_core_bpe") else None
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [single(w.encode()) for w in words] if single else [coder.encode_ordinary(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], ["word", "ids", "uses"])

    return encode


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts come with the dictionary of their batch on the first row of each batch's group only."""
    import numpy as np

    lengths = starts = flat = None
    current = None
    for batch in batches:
        chunks = batch.column(0).to_pylist()
        docs, ids, ends = [], [], [0]
        dictionary, at = batch.column(2), batch.column(3)
        for i, chunk in enumerate(chunks):
            if dictionary[i].is_valid:
                rows = dictionary[i].values
                offsets = rows.offsets.to_numpy()
                lengths, starts, flat, current = np.diff(offsets), offsets[:-1], rows.values.to_numpy(), chunk
                continue
            if chunk != current:
                raise ValueError("a text came before the dictionary of its batch")
            own = at[i].values.to_numpy()
            size = lengths[own]
            total = int(size.sum())
            if total:
                ahead = np.repeat(starts[own] - (np.cumsum(size) - size), size)
                ids.append(flat[ahead + np.arange(total)])
            docs.append(batch.column(1)[i].as_py())
            ends.append(ends[-1] + total)
        if docs:
            values = np.concatenate(ids) if ids else np.zeros(0, "int32")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], ["doc_id", "ids"])


def encode(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each row of ``documents``."""
    source = documents.select("doc_id", "text")
    split = cut(source.mapInArrow(_splitter(), "chunk long, doc_id long, at array<int>, words array<string>"))
    words = split.filter("words is not null").select("chunk", F.posexplode("words").alias("place", "word"))
    file = documents.sparkSession.sparkContext.broadcast(Path(folder, name).read_bytes())
    # each distinct word once, with the number of dictionaries that hold it
    vocabulary = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("uses")).mapInArrow(_encoder(file), "word string, ids array<int>, uses long"))
    total = vocabulary.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).first().n
    found = join_counted(words, vocabulary, ["word"], "uses", total)
    dictionaries = found.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"]).alias("ids"))
    empty = F.array().cast("array<int>")
    texts = split.filter("at is not null").select("chunk", "doc_id", F.lit(None).cast("array<array<int>>").alias("dictionary"), "at")
    chunks = split.filter("words is not null").select("chunk").join(dictionaries, "chunk", "left")
    heads = chunks.select("chunk", F.lit(None).cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<array<int>>")).alias("dictionary"), empty.alias("at"))
    together = heads.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", F.col("dictionary").isNull())
    return together.select("chunk", "doc_id", "dictionary", "at").mapInArrow(_reassemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """token and bytes of the vocabulary."""
    rows = ranks(Path(folder, name).read_bytes())
    table = pa.table({"token": pa.array(rows.values(), pa.int32()), "bytes": pa.array(rows.keys(), pa.binary())})
    return spark.createDataFrame(table)


def decode(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; an empty list gives an empty text.

    The table of token bytes has as many rows as the vocabulary, whatever the corpus, so it is broadcast.
    """
    spark = encoded.sparkSession
    tokens = encoded.select("doc_id", F.posexplode_outer("ids").alias("place", "token"))
    named = tokens.join(F.broadcast(token_bytes(spark, folder, name)), "token", "left")
    ordered = F.array_sort(F.collect_list(F.struct("place", "bytes")))
    pieces = F.transform(F.filter(ordered, lambda x: x["bytes"].isNotNull()), lambda x: x["bytes"])
    # the pieces are joined once, as hexadecimal digits, since joining two at a time copies the text each time
    whole = F.unhex(F.array_join(F.transform(pieces, F.hex), ""))
    return named.groupBy("doc_id").agg(F.decode(whole, "UTF-8").alias("text"))
