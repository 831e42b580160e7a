"""Readers. Every one has an explicit schema."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from .. import schemas
from ..functions.text import decode_content, parse_topics, valid_text
from .manifest import Manifest


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def flat_schema(schema: T.StructType) -> T.StructType:
    """The schema as a CSV holds it: arrays are text."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType)
        for f in schema.fields])


def read_repos(spark: SparkSession, path: str, schema: T.StructType = schemas.ENRICHED,
               required: Sequence[str] = ("full_name",), fmt: str = "csv",
               missing: str = "error", multi_line: bool = True) -> DataFrame:
    """A repository table from CSV or Parquet.

    A missing path or a header without a required column is an error. With
    ``missing="empty"`` it gives an empty table, so that an incremental run starts afresh.
    Line breaks inside CSV fields cost one task per file; ``multi_line=False`` splits files
    that have none. Array columns of a CSV are parsed from their text.
    Columns are matched by header name; ones the file lacks come back as NULL, and so do
    empty texts, which a CSV cannot tell from missing ones.
    """
    if missing not in ("error", "empty"):
        raise ValueError("missing is 'error' or 'empty'")
    empty = spark.createDataFrame([], schema)
    try:
        if fmt != "csv":
            df = spark.read.format(fmt).load(path)
            header = df.columns
        else:
            options = dict(header=True, multiLine=multi_line, escape='"', enforceSchema=False)
            header = spark.read.options(header=True, inferSchema=False, escape='"').csv(path).columns
            flat = {f.name: f for f in flat_schema(schema).fields}
            wanted = T.StructType([flat.get(c, T.StructField(c, T.StringType())) for c in header])
            df = spark.read.options(**options).schema(wanted).csv(path)
    except AnalysisException as error:
        if _missing(error) and missing == "empty":
            return empty
        raise
    if not set(required) <= set(header):
        if missing == "empty":
            return empty
        raise ValueError(f"{path} lacks the columns {sorted(set(required) - set(header))}")
    columns = []
    for f in schema.fields:
        if f.name not in header:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif fmt == "csv" and isinstance(f.dataType, T.ArrayType):
            columns.append(parse_topics(f.name).alias(f.name))
        else:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*columns)


SEARCH_PAGE = T.StructType([
    T.StructField("total_count", T.LongType()),
    T.StructField("items", T.ArrayType(schemas.SEARCH_HIT)),
])


def _json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """Records that are no JSON of this form fail the read; they are never NULL rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def read_repo_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Search hits from dumped result pages (``{"total_count": n, "items": [...]}``).

    One page per line, or with ``multi_line`` one (pretty-printed) page per file.
    """
    return _json(spark, path, SEARCH_PAGE, multi_line).select(F.inline("items"))


def read_details_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Repository details, one JSON object per line, or per file with ``multi_line``."""
    return _json(spark, path, schemas.DETAILS, multi_line)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """File contents by repository and path.

    ``binaryFile`` reads a checked-out tree ``<root>/<owner>/<name>/<file path>``; text is
    decoded as UTF-8 without the bytes that are not. Spark lists no empty files there, so a
    presence test that has to see them needs a table of paths.
    """
    if fmt != "binaryFile":
        return spark.read.schema(schemas.FILES).format(fmt).load(path)
    # the scheme and host of a path may be spelled out or not
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path.rstrip("/"))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*" + _quoted(root.strip("/")) + r"/(.*)$"
    relative = F.when(F.col("path").rlike(pattern), F.regexp_extract("path", pattern, 1)).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {path}: "), F.col("path"))))
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(relative.alias("rel"), "content")
    )
    text = valid_text("content")
    return raw.select(
        F.substring_index("rel", "/", 2).alias("full_name"),
        F.regexp_extract("rel", r"^[^/]+/[^/]+/(.*)$", 1).alias("path"),
        F.lit(False).alias("is_dir"), text.alias("content"))


VERDICTS = T.StructType([
    T.StructField("full_name", T.StringType()), T.StructField("readme_lang", T.StringType()),
    T.StructField("readme_lang_conf", T.DoubleType())])
FINISHED = T.StructType([T.StructField("full_name", T.StringType()), T.StructField("outcome", T.StringType())])


def _read_runs(spark: SparkSession, path: str, schema: T.StructType, before: str | None) -> DataFrame:
    """What runs have added to a table; ``before`` leaves out the run of that name."""
    manifest = Manifest(spark, path)
    return manifest.read(schema, [run for run in manifest.entries() if run != before])


def read_finished(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """Repositories that earlier runs have finished; none if there was no run yet.

    ``before`` leaves out the run of that name, so that a repeated run does its work again.
    """
    return _read_runs(spark, path, FINISHED, before)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """The mentions of all runs; none if there was no run yet."""
    return _read_runs(spark, path, schemas.MENTIONS, None)


def read_verdicts(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """README verdicts of earlier runs: ``full_name, readme_lang, readme_lang_conf``."""
    return _read_runs(spark, path, VERDICTS, before)


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def decode_files(files: DataFrame, encoded: str = "content") -> DataFrame:
    """Replaces base64 contents by their text."""
    return files.withColumn(encoded, decode_content(encoded))
