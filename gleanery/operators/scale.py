"""Building blocks that keep plans flat when keys are hot and data is large.

* ``cut`` writes an intermediate result once and reads it back, so that lineage
  ends in shared storage and a lost executor costs only its own tasks.
* ``join_counted`` joins to a table of unique keys whose match counts are known.
  Keys that hold more than a share of all rows are at most ``1 / share`` many,
  as the counts add up to the total; they alone are broadcast.
* ``running_total`` is a cumulative sum over an order within groups that never
  brings a group into one task.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with more than this share of the rows counts as hot; at most 1,000 keys can.
HOT_SHARE = 1 / 1000


#: The folder of each local application that names none.
_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local master may leave it unset and gets a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN_FOLDER:
        _OWN_FOLDER[context.applicationId] = tempfile.mkdtemp(prefix="gleanery-")
    return _OWN_FOLDER[context.applicationId]


def place(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame, *partition_by: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    It keeps the lineage short, is columnar, and survives the loss of any
    executor. The table is removed when the application ends, or when another cut
    ``replaces`` it: loops so free the copies that no later round reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    system, where = place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if replaces is not None:
        free(replaces)
    return out


def free(table: DataFrame) -> None:
    """Removes what ``cut`` wrote for this table; nothing may read it any more."""
    system, where = place(table.sparkSession, table.written_to)
    system.delete(where, True)


class Pointers:
    """Numbered files of JSON in a folder; the largest number is the current one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/pointers"

    def _numbers(self) -> list[int]:
        system, where = place(self.spark, self.folder)
        if not system.exists(where):
            return []
        names = [f.getPath().getName() for f in system.listStatus(where)]
        return sorted(int(n[2:]) for n in names if n.startswith("p-"))

    def read(self) -> dict | None:
        """What the current pointer says, None before the first."""
        numbers = self._numbers()
        return json.loads(self.spark.read.text(f"{self.folder}/p-{numbers[-1]}").first().value) if numbers else None

    def add(self, said: dict) -> None:
        """Publishes the next pointer; fails if another writer has published meanwhile."""
        number = max(self._numbers(), default=-1) + 1
        system, draft = place(self.spark, f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        _, final = place(self.spark, f"{self.folder}/p-{number}")
        if system.exists(final) or not system.rename(draft, final):
            raise RuntimeError(f"pointer {number} was published by another writer")


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``left`` to ``right``, which has each key once and in ``count`` its rows in ``left``.

    ``total`` is the number of rows of ``left``. Hot keys are broadcast (at most
    ``1 / share`` rows of ``right``), so the shuffled rest has no key above that share.
    Null keys match nothing, as in any join.
    """
    limit = total * share
    hot = F.broadcast(right.filter(F.col(count) > limit))
    cold = right.filter(F.col(count) <= limit)
    by_hot = left.join(hot, keys)
    by_cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return by_hot.unionByName(by_cold)


def running_total(df: DataFrame, group: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows before this one in its group.

    Rows are range-partitioned by group and order and the parts written once.
    Within a part the sum is a plain window; what earlier parts hold of the same
    group is added from a table with at most one row per part, since only the
    first group of a part can have begun in an earlier one. That table is
    broadcast. ``order`` must be total within a group.
    """
    columns = df.columns
    ranged = (
        df.withColumn("_w", weight)
        .repartitionByRange(*[F.col(c) for c in group], *order)
        .sortWithinPartitions(*[F.col(c) for c in group], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    parts = cut(ranged)
    sums = parts.groupBy("_part", *group).agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_before", F.sum("_s").over(before)).filter("_before is not null").select("_part", *[F.col(c).alias(f"_g_{c}") for c in group], "_before")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    same = (F.col("_part") == F.col("_p")) & F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(F.broadcast(carried.withColumnRenamed("_part", "_p")), same, "left")
    return joined.select(*columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name))
