"""Session settings for local runs, and the shared folder for written state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("corpuscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for written tables and stream state.

    Every executor has to reach it, so a machine-local folder is only taken when the
    whole session runs on one machine and nothing is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscope-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a written table that nothing reads any more; one that is gone already is fine."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_WRITTEN: list[str] = []
_TABLES: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the folders of all tables :func:`written` so far.

    Results that still read one have to be stored before.
    """
    while _TABLES:
        spark.sql(f"drop table if exists {_TABLES.pop()}")
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The table after one trip through the shared folder.

    Cuts the lineage where several results grow out of one table. The files outlive lost
    executors, so nothing above them is computed again.
    """
    folder = shared_folder(df.sparkSession, purpose)
    _WRITTEN.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """The table stored in sorted buckets of ``key``, below the shared folder.

    Joins and groups by the key read it without a shuffle; only the other side moves.
    """
    folder, name = shared_folder(df.sparkSession, purpose), f"corpuscope_{purpose}_{uuid.uuid4().hex}"
    _WRITTEN.append(folder)
    _TABLES.append(name)
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", folder).saveAsTable(name))
    return df.sparkSession.table(name)
