"""Incremental index: batches of pages are merged into a log of changes.

The state is three tables of changes, ``documents`` (doc_id, url, fingerprint,
words), ``urls`` (url, doc_id) and ``fingerprints`` (fingerprint, doc_id), each in
buckets by the hash of its key. A batch looks up its keys in their buckets only,
and of the texts' words it reads none, so its cost follows the batch and not the
index. It appends what it changes as a new version. The state is the latest change
of each key; every ``compact_every`` versions it is written out as the first version
of a new generation, so a bucket's log stays short. Postings follow from the
documents, so those of an updated document are retracted with it.

Pointers are append-only: each publication adds a file of the next number, moved
into place whole, and readers take the largest. None is ever overwritten, so an
interrupted publication leaves the state before it. The pointer also holds the
next identifier and the number of the last batch of each stream, so a batch that
was published before a failure is skipped by whoever reads the store next.

A page updates the document of its URL; else the one that owns its fingerprint,
which then moves to the new URL; else it is a new document. Within a batch the
last record of a URL counts. ``keep_stale=False`` drops the fingerprints that a
document no longer has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.scale import Pointers, cut, free, running_total

#: Columns, key and value of each table's changes; a null value removes the key.
TABLES = {
    "documents": ("doc_id long, url string, fingerprint string, words array<string>", "doc_id", ("url", "fingerprint", "words")),
    "urls": ("url string, doc_id long", "url", ("doc_id",)),
    "fingerprints": ("fingerprint string, doc_id long", "fingerprint", ("doc_id",)),
}
_EMPTY = {"generation": 0, "version": -1, "since": -1, "next_id": 0, "batches": {}}


class IndexStore:
    """Changes by generation, version and bucket in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, compact_every: int = 16):
        self.spark, self.folder, self.buckets, self.compact_every = spark, folder, buckets, compact_every
        self.pointers = Pointers(spark, folder)

    def pointer(self) -> dict:
        """Generation, version (-1 for an empty store), its first version, next identifier, batches published."""
        return self.pointers.read() or dict(_EMPTY)

    def version(self) -> int:
        return self.pointer()["version"]

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None, only: tuple[str, ...] = ()) -> DataFrame:
        """``documents``, ``urls``, ``fingerprints`` or ``postings`` (term, doc_id) of the current version, or only some buckets of it, or ``only`` the first of its values."""
        if name == "postings":
            return self.read("documents").select(F.explode(F.array_distinct("words")).alias("term"), "doc_id").filter("term is not null")
        schema, key, values = TABLES[name]
        # the latest change is taken as a whole, so values that nobody asks for are left out before
        values = only or values
        at = self.pointer()
        if at["version"] < 0:
            return self.spark.createDataFrame([], schema).select(key, *values)
        # a generation begins with whole buckets as folders, which later versions amend by rows sorted by bucket
        parts = [f"{self.folder}/g{at['generation']}/{name}/{part}" for part in (["base"] if at["since"] >= 0 else []) + (["log"] if at["version"] > at["since"] else [])]
        logs = [self.spark.read.schema(schema + ", v int, b int").parquet(part) for part in parts]
        log = reduce(DataFrame.unionByName, logs).filter(F.col("v") <= at["version"])
        if buckets is not None:
            log = log.filter(F.col("b").isin(*buckets))
        latest = log.groupBy(key).agg(F.max_by(F.struct(*values), "v").alias("_s")).select(key, "_s.*")
        return latest.filter(F.col(values[0]).isNotNull())

    def near(self, name: str, keys: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
        """The current rows in the buckets of ``keys``; at most the number of buckets comes to the driver."""
        key = TABLES[name][1]
        if self.version() < 0:
            return self.read(name, only=only)
        used = [r.b for r in keys.filter(F.col(key).isNotNull()).select(self.bucket(key).alias("b")).distinct().collect()]
        return self.read(name, used, only)

    def publish(self, changes: dict[str, DataFrame], version: int, next_id: int = 0, generation: int | None = None, batch: tuple[str, int] | None = None) -> None:
        at = self.pointer()
        begun = generation is not None
        generation = generation if begun else at["generation"]
        for name, (_, key, _) in TABLES.items():
            placed = changes[name].withColumn("b", self.bucket(key))
            if begun:
                placed.withColumn("v", F.lit(version)).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.folder}/g{generation}/{name}/base")
            else:
                placed.repartitionByRange("b").sortWithinPartitions("b").write.mode("overwrite").parquet(f"{self.folder}/g{generation}/{name}/log/v={version}")
        batches = {**at["batches"], **({batch[0]: batch[1]} if batch else {})}
        self.pointers.add({"generation": generation, "version": version, "since": version if begun else at["since"], "next_id": max(next_id, at["next_id"]), "batches": batches})

    def compact(self) -> None:
        """Writes the current state as a generation of one version; older ones may then be removed."""
        at = self.pointer()
        if at["version"] >= 0:
            self.publish({name: self.read(name) for name in TABLES}, at["version"], generation=at["generation"] + 1)

    def merge(self, batch: DataFrame, keep_stale: bool = True, number: tuple[str, int] | None = None) -> None:
        """Merges a batch, publishes the next version, and compacts a log that has grown long."""
        at = self.pointer()
        written: list[DataFrame] = []
        changes = changed(self, batch, keep_stale, written)
        most = changes["documents"].agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("m")).first().m
        self.publish(changes, at["version"] + 1, most + 1, batch=number)
        for table in written:
            free(table)
        if at["version"] + 1 - at["since"] >= self.compact_every:
            self.compact()


def changed(store: IndexStore, batch: DataFrame, keep_stale: bool = True, written: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """The changes that a batch of pages (url, fingerprint, words, seq) makes. ``written`` gets the tables that they are read from."""
    written = [] if written is None else written

    def kept(df: DataFrame) -> DataFrame:
        written.append(cut(df))
        return written[-1]

    start = store.pointer()["next_id"]
    # the words are written once and fetched by their row's number once it is known which rows stay
    whole = kept(batch.select("url", "fingerprint", "words", "seq", F.monotonically_increasing_id().alias("_n")))
    last = kept(whole.groupBy("url").agg(F.max_by(F.struct("fingerprint", "_n"), "seq").alias("_r"), F.max("seq").alias("seq")).select("url", "_r.fingerprint", "_r._n", "seq"))
    by_url = last.join(store.near("urls", last).select("url", F.col("doc_id").alias("_u")), "url", "left")
    prints = store.near("fingerprints", last)
    owned = kept(by_url.join(prints.select("fingerprint", F.col("doc_id").alias("_f")), "fingerprint", "left").withColumn("doc_id", F.coalesce("_u", "_f")))
    # pages new to the index that share a fingerprint are one document, owned by the last of them
    fresh = owned.filter("doc_id is null").withColumn("_key", F.coalesce("fingerprint", F.concat(F.lit("url:"), "url")))
    firsts = fresh.groupBy("_key").agg(F.min("seq").alias("_first"))
    ids = fresh.join(_numbered(firsts, start), "_key").drop("doc_id").withColumnRenamed("_id", "doc_id")
    every = kept(owned.filter("doc_id is not null").select("doc_id", "url", "fingerprint", "_n", "seq").unionByName(ids.select("doc_id", "url", "fingerprint", "_n", "seq")))
    best = kept(every.groupBy("doc_id").agg(F.max_by(F.struct("url", "fingerprint", "_n"), "seq").alias("_r")).select("doc_id", "_r.*"))
    documents = best.join(whole.select("_n", "words"), "_n", "left").select("doc_id", "url", "fingerprint", "words")
    owners = every.filter("fingerprint is not null").groupBy("fingerprint").agg(F.max_by("doc_id", "seq").alias("doc_id"))
    known = best.filter(F.col("doc_id") < start).select("doc_id")
    before = store.near("documents", known, only=("url",)).join(known, "doc_id").select(F.col("url").alias("_was"), "doc_id")
    nobody = F.lit(None).cast("long").alias("doc_id")
    here = best.select("url", "doc_id")
    left = before.join(here.select(F.col("url").alias("_was")), "_was", "left_anti").select(F.col("_was").alias("url"), nobody)
    if not keep_stale:
        # fingerprints are found by their document, so all of them are read
        stale = store.read("fingerprints").join(best.select("doc_id"), "doc_id", "left_semi").join(owners, "fingerprint", "left_anti")
        owners = owners.unionByName(stale.select("fingerprint", nobody))
    return {"documents": documents, "urls": here.unionByName(left), "fingerprints": owners}


def _numbered(firsts: DataFrame, start: int) -> DataFrame:
    """_key and _id: consecutive numbers by arrival, without sorting all rows in one task."""
    keyed = firsts.withColumn("_g", F.lit(0))
    ranked = running_total(keyed, ["_g"], [F.col("_first").asc(), F.col("_key").asc()], F.lit(1), "_before")
    return ranked.select("_key", (F.col("_before") + start).cast("long").alias("_id"))


def upsert(store: IndexStore, batch: DataFrame, keep_stale: bool = True) -> None:
    """Merges a batch and publishes the next version."""
    store.merge(batch, keep_stale)


def incremental_index(pages: DataFrame, store: IndexStore, checkpoint: str, keep_stale: bool = True) -> StreamingQuery:
    """A query that merges a stream of pages (url, fingerprint, words, seq) batch by batch until the source is read.

    The pointer holds the number of the stream's last published batch, so one published before a failure is skipped after it.
    """

    def one(batch: DataFrame, number: int) -> None:
        if store.pointer()["batches"].get(checkpoint, -1) < number:
            store.merge(batch, keep_stale, (checkpoint, number))

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
