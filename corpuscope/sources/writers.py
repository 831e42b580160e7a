"""Writers. Files are written in parallel; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ranking import dedup_best, sort_output
from ..session import written
from .manifest import Manifest


def flat(df: DataFrame) -> DataFrame:
    """Arrays as JSON text, the only form a CSV can hold."""
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType))
        else F.col(f.name) for f in df.schema.fields])


def write_repos(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "json")) -> dict[str, str]:
    """The table, one best row per repository, best first, once per format.

    Returns the folder of each format. Rows are range-partitioned by rank, so file order is
    the ranking and the write stays parallel. The best rows are determined once and stored
    for all formats.
    """
    best = dedup_best(df) if "full_name" in df.columns else df
    ranked = sort_output(written(best, "best") if len(formats) > 1 else best)
    folders = {}
    for fmt in formats:
        folders[fmt] = f"{path}/{fmt}"
        writer = (flat(ranked) if fmt == "csv" else ranked).write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(fmt).save(folders[fmt])
    return folders


def _append(df: DataFrame, path: str, run: str) -> str:
    """Adds the rows of one run to the table at ``path``.

    They are written first and committed by a manifest, so a run that dies adds nothing and one
    that is repeated replaces its own rows in one step. Read it with ``sources.readers``.
    """
    Manifest(df.sparkSession, path).replace(run, df)
    return path


def append_mentions(df: DataFrame, path: str, run: str) -> str:
    """Adds the mention rows of one run; a repeated run replaces its own."""
    return _append(df, path, run)


def append_finished(summary: DataFrame, skipped: DataFrame, path: str, run: str) -> str:
    """Adds the repositories that a run has searched or skipped: ``full_name, outcome``.

    Written after the mentions. A later run leaves these repositories out.
    """
    rows = summary.select(F.col("repo_id").alias("full_name"), F.lit("searched").alias("outcome"))
    rows = rows.unionByName(skipped.select(F.col("repo_id").alias("full_name"), F.lit("skipped").alias("outcome")))
    return _append(rows, path, run)


def append_verdicts(verdicts: DataFrame, path: str, run: str) -> str:
    """Adds the README verdicts of one run: ``full_name, readme_lang, readme_lang_conf``."""
    return _append(verdicts.select("full_name", "readme_lang", "readme_lang_conf"), path, run)


def write_split(staged: DataFrame, path: str) -> str:
    """Survivors and excluded rows in two partitions of one table, from one pass."""
    decision = F.when(F.col("exclusion_stage").isNull(), "survivor").otherwise("excluded")
    staged.withColumn("decision", decision).write.mode("overwrite").partitionBy("decision").parquet(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """The one-row JSON report as a text file."""
    report.select("report").write.mode("overwrite").text(path)
    return path
