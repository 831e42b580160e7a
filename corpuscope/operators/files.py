"""Which files a repository has, and what its README and manifests say.

Presence needs paths only, so its scan never reads contents; the content metrics push a
``path IN (...)`` filter to the scan. Text is reduced to counters before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import taxonomy as tx
from ..functions import text as fx
from ..session import written


def _below(path: str) -> Column:
    return F.col("path").startswith(path + "/")


def is_path(path: str) -> Column:
    """The row shows that ``path`` exists, as a file or as a directory."""
    return (F.col("path") == path) | _below(path)


def is_directory(path: str) -> Column:
    """The row shows that ``path`` exists and is a directory."""
    return ((F.col("path") == path) & F.coalesce(F.col("is_dir"), F.lit(False))) | _below(path)


def path_flags(files: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per repository with each flag true if any of its paths makes it true."""
    return files.groupBy("full_name").agg(
        *[F.coalesce(F.bool_or(cond), F.lit(False)).alias(name) for name, cond in flags.items()])


def file_exists(files: DataFrame, path: str) -> DataFrame:
    return path_flags(files, {"file_exists": is_path(path)})


def dir_exists(files: DataFrame, path: str) -> DataFrame:
    return path_flags(files, {"dir_exists": is_directory(path)})


def doc_flags() -> dict[str, Column]:
    return {"has_contributing": is_path("CONTRIBUTING.md"),
            "has_code_of_conduct": is_path("CODE_OF_CONDUCT.md")}


def test_directory_flag() -> dict[str, Column]:
    return {"has_test_directory": fx.any_of([is_directory(d) for d in tx.TEST_DIRECTORIES])}


def ci_flag() -> dict[str, Column]:
    return {"has_ci_config": fx.any_of([is_path(p) for p in tx.CI_PATHS])}


def files_profile(files: DataFrame) -> DataFrame:
    """All presence flags from one path-only scan and one aggregation."""
    return path_flags(files, {**doc_flags(), **test_directory_flag(), **ci_flag()})


def has_documents(files: DataFrame) -> DataFrame:
    return path_flags(files, doc_flags())


def has_test_directory(files: DataFrame) -> DataFrame:
    return path_flags(files, test_directory_flag())


def has_ci_config(files: DataFrame) -> DataFrame:
    return path_flags(files, ci_flag())


def ai_dependency_count(files: DataFrame, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Number of (manifest, library) pairs in which the library's name occurs."""
    return (
        files.filter(F.col("path").isin(*tx.MANIFEST_FILES))
        .groupBy("full_name")
        .agg(F.sum(fx.library_hits(F.lower("content"), tax.libraries)).alias("ai_dependency_count"))
    )


def content_profile(files: DataFrame, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """README metrics and dependency count from one scan of the manifest files.

    The counters are computed per file in front of the aggregation, so only numbers move.
    """
    is_readme = F.col("path") == "README.md"
    # lower-cased once here: the counters below read the column many times
    lowered = files.filter(F.col("path").isin(*tx.MANIFEST_FILES)).select(
        "full_name",
        F.when(is_readme, F.length("content")).alias("readme_length"),
        F.when(is_readme, F.lower("content")).alias("_readme"),
        F.lower("content").alias("_manifest"),
    )
    return lowered.groupBy("full_name").agg(
        F.sum(F.coalesce("readme_length", F.lit(0))).alias("readme_length"),
        F.sum(fx.lowered_keyword_count("_readme", tax.ai_terms)).alias("ai_keyword_count"),
        F.sum(fx.lowered_keyword_count("_readme", tax.readme_test_terms)).alias("test_keyword_count"),
        F.sum(fx.lowered_keyword_count("_readme", tax.phrases)).alias("intersection_phrase_count"),
        F.sum(fx.library_hits("_manifest", tax.libraries)).alias("ai_dependency_count"),
    )


def readme_rank() -> Column:
    """0 for the preferred README name, NULL for any other file."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(tx.README_NAMES):
        rank = F.when(F.col("path") == name, i).otherwise(rank)
    return rank


def readme_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").isin(*tx.README_NAMES)).withColumn("readme_rank", readme_rank())


def chosen_readme(files: DataFrame) -> DataFrame:
    """Per repository the rank of the README that counts; reads paths only."""
    return readme_files(files).groupBy("full_name").agg(F.min("readme_rank").alias("readme_rank"))


def pick_readme(files: DataFrame) -> DataFrame:
    """The first README of each repository in order of preference, with its content.

    Few repositories have more than one, so the variants that lose are found on paths alone and
    stored; Spark then knows their size, and where it is small the contents stay in place.
    """
    best = chosen_readme(files).withColumnRenamed("readme_rank", "best")
    variants = readme_files(files).select("full_name", "readme_rank").distinct()
    beaten = written(variants.join(best, "full_name").filter(
        F.col("readme_rank") > F.col("best")).drop("best"), "beaten-readmes")
    return readme_files(files).join(beaten, ["full_name", "readme_rank"], "left_anti").select(
        "full_name", "path", "content")


def artifact_path() -> Column:
    """The agent-configuration path this file stands for, else NULL."""
    return F.coalesce(*[F.when(is_path(p), F.lit(p)) for p, _ in tx.CONFIG_ARTIFACTS])


def artifact_tool(path: Sequence[str] | str) -> Column:
    pairs = [F.lit(v) for pair in tx.CONFIG_ARTIFACTS for v in pair]
    return F.element_at(F.create_map(*pairs), F.col(path))


def present_artifacts(files: DataFrame) -> DataFrame:
    """Distinct (repository, configuration path) pairs with the tool each one configures."""
    hit = fx.any_of([is_path(p) for p, _ in tx.CONFIG_ARTIFACTS])
    return (
        files.filter(hit).select("full_name", artifact_path().alias("artifact")).distinct()
        .withColumn("tool", artifact_tool("artifact"))
    )
