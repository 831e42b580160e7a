"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corpuscope.session import remove, shared_folder

#: Rows an Arrow batch holds at most; Spark's own byte limit holds as well.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learned from (null id: no)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


_RESIDENT: dict[str, dict[str, tuple]] = {}


def resident(operator: str, part: str, key, make: Callable):
    """What a Python worker keeps between tasks, made by ``make`` when ``key`` is new.

    Workers outlive stages. Only one operator's things are kept, so the memory of a worker that has
    served many operators is bounded by the largest of them; what others left is given back.
    """
    if operator not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[operator] = {}
    parts = _RESIDENT[operator]
    if part not in parts or parts[part][0] != key:
        parts.pop(part, None)
        parts[part] = (key, make())
    return parts[part][1]


def give_back() -> None:
    """Return freed memory to the machine, where its allocator can be told to."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` different rows, those with the smallest hash of ``key`` and then of the whole row.

    The same ones on every run. A first cut by the hash keeps about 1.2 n rows, so that few rows are
    ranked; rows that repeat count once, and of rows that share a key the first by hash is taken.
    """
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(1 << 30))
    total = rows.count()
    kept = rows.where(spot < int((1 << 30) * min(1.0, 1.2 * n / max(total, 1)) + 1))
    columns = F.struct(*(F.col(c) for c in rows.columns))
    first = kept.groupBy(key).agg(F.min_by(columns, F.struct(F.xxhash64(*rows.columns), columns)).alias("first")).select("first.*")
    return first.orderBy(spot, key).limit(n)


def labelled(documents: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """``doc_id, text, quality, toxic`` of at most ``n`` labelled documents outside the held-out fold.

    The label rows are drawn first, one an id; they are at most ``n``, so they may be broadcast to the
    texts. Of several texts with one id the first by hash is taken, so the bound holds for the
    result too. Ordered by a hash of the id, so that a beginning of it is a draw as well.
    """
    drawn = bounded_sample(
        labels.select("doc_id", "quality", "toxic").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()),
        "doc_id", n)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    met = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    return met.select("doc_id", "text", "quality", "toxic").orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id")


#: Whether Spark deletes an execution's shuffle files when it ends, not when its driver's garbage is collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Kept:
    """Tables written once below the shared folder, so that lost executors cost no recomputation.

    A written table needs no shuffle files any more, so they go with the write that made them.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark, self.purpose = spark, purpose

    def write(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark, self.purpose)
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(folder)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(folder)
        out.folder = folder
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df.folder)


def numbered(kept: Kept, rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place in ``order``, counted from 1 over the whole table, as column ``name``.

    Rows are sorted in ranges and counted within them; equal rows may lie in several ranges. A range's
    first number comes from the sizes of those before it, one row a shuffle partition.
    """
    spot = F.rand(29)
    ranged = rows.repartitionByRange(*order, spot).sortWithinPartitions(*order)
    placed = kept.write(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    firsts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(firsts), "_range").withColumn(
        name, F.col("_first") + inside + 1).drop("_at", "_range", "_first")
