"""Incremental runs over landing folders with Structured Streaming.

Offsets and state live in a checkpoint folder, so a run that dies goes on where it was and
a finished one only takes in new files. Batch writes are committed by a manifest: a batch that
is repeated after a failure replaces what it had written or finds its commit done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import taxonomy as tx
from ..operators.incremental import resume_anti_join
from ..operators.mentions import attach_repository, commit_findings
from ..operators.ranking import dedup_best
from ..sources.manifest import Manifest


def read_landing(spark: SparkSession, path: str, schema: T.StructType, name_glob: str | None = None,
                 max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_detect(commits: DataFrame, scanned: DataFrame, out: str, checkpoint: str,
                  tax: tx.Taxonomy = tx.DEFAULT) -> StreamingQuery:
    """Mentions in arriving commits, appended to a Parquet table.

    Stateless: detection looks at one commit, and ``scanned`` (a static table of
    repositories) joins the mention rows only. It is read in every batch, so it should be a
    stored table rather than a long computation.
    """
    return (
        attach_repository(commit_findings(commits, tax), scanned).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


#: Names that a task remembers while it drops repeats, and buckets of a table that batches are merged into.
NAMES, BUCKETS = 1_000_000, 64


def _once_a_task(event_time: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops rows whose name the task has passed on already, but for the latest row of a batch.

    That one may carry the watermark on. A task that has met too many names starts afresh, which
    costs work later and changes nothing.
    """
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str | None] = set()
        for batch in batches:
            keep = []
            for name in batch.column(batch.schema.get_field_index("full_name")).to_pylist():
                keep.append(name not in seen)
                seen.add(name)
            times = batch.column(batch.schema.get_field_index(event_time)).cast(pa.int64())
            latest = pc.max(times).as_py()
            if latest is not None:
                keep[pc.index(times, latest).as_py()] = True
            if len(seen) > NAMES:
                seen.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return once


def stream_dedup(hits: DataFrame, out: str, checkpoint: str, event_time: str,
                 delay: str = "7 days") -> StreamingQuery:
    """First arrival of each repository, with state bounded by a watermark.

    A repository seen again more than ``delay`` later counts as new; use
    :func:`stream_first_seen` where that must not happen. Repeats within a task of a batch are
    dropped where they are read, so a name with many arrivals reaches the task that keeps its
    state about once per task.
    """
    first = hits.mapInArrow(_once_a_task(event_time), hits.schema)
    return (
        first.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["full_name"])
        .writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def _by_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class _Buckets:
    """A table cut into hash buckets of ``full_name``; a batch rewrites those it touches."""

    def __init__(self, manifest: Manifest, count: int, kind: str) -> None:
        self.manifest, self.count, self.kind = manifest, count, kind
        other = [n for n in manifest.entries() if not n.startswith(f"{kind}/{count}/")]
        if other:
            raise ValueError(f"{manifest.root} is not cut into {count} buckets: {other[0]}")

    def place(self) -> Column:
        return F.pmod(F.xxhash64("full_name"), F.lit(self.count)).cast("int")

    def names(self, rows: DataFrame) -> list[str]:
        """The buckets that the rows fall into, at most ``count``."""
        return [f"{self.kind}/{self.count}/{r[0]}" for r in rows.select(self.place()).distinct().collect()]

    def write(self, rows: DataFrame, names: list[str], number: int) -> None:
        """Put the rows in place of the named buckets."""
        entries = self.manifest.entries()
        if names:
            folder = self.manifest.fresh()
            rows.withColumn("_bucket", self.place()).repartition("_bucket").write.partitionBy("_bucket").parquet(
                f"{self.manifest.root}/{folder}")
            entries |= {n: f"{folder}/_bucket={n.rsplit('/', 1)[1]}" for n in names}
        self.manifest.commit(entries, number)


def stream_first_seen(hits: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """First arrival of each repository, exactly.

    The names seen so far are kept in hash buckets, so they may outgrow any state store and a batch
    reads those of its own names' buckets only. Each batch drops its inner duplicates and what those
    buckets hold, and adds its new rows to the output; :func:`read_first_seen` reads it. The
    buckets' manifest commits both: a batch that died is repeated, a committed one is not.
    """
    def step(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        table = _Buckets(Manifest(spark, f"{out}/seen"), buckets, "seen")
        if batch <= table.manifest.last():
            return
        names = table.names(rows)
        key = T.StructType([rows.schema["full_name"]])
        seen = table.manifest.read(key, names)
        added = f"{out}/rows/batch={batch}"
        resume_anti_join(rows.dropDuplicates(["full_name"]), seen).write.mode("overwrite").parquet(added)
        new = spark.read.schema(key).parquet(added)
        table.write(seen.unionByName(new), names, batch)

    return _by_batch(hits, checkpoint, step)


def read_first_seen(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows that :func:`stream_first_seen` has committed."""
    last = Manifest(spark, f"{out}/seen").last()
    if last < 0:
        return spark.createDataFrame([], schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(f"{out}/rows").filter(F.col("batch") <= last).drop("batch")


def stream_merge_best(results: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the best row per repository over all arrivals; :func:`read_merged` reads the table.

    The table is cut into hash buckets of the name. A batch merges its rows with the buckets they
    fall into and writes those anew; all others stay as they are. A batch is one commit, so a
    batch that died changes nothing and a committed one is not repeated.
    """
    def step(rows: DataFrame, batch: int) -> None:
        table = _Buckets(Manifest(rows.sparkSession, out), buckets, "best")
        if batch <= table.manifest.last():
            return
        names = table.names(rows)
        table.write(merge_best(table.manifest.read(rows.schema, names), rows), names, batch)

    return _by_batch(results, checkpoint, step)


def read_merged(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The table as of the last committed batch of :func:`stream_merge_best`."""
    return Manifest(spark, out).read(schema)


def merge_best(old: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier and new results as one table with the best row of each repository."""
    return dedup_best(old.unionByName(new))
