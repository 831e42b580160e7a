"""Row-wise projections of search hits and repository details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas, taxonomy as tx
from ..functions.dates import days_since


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def _or_false(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def normalize_repo(hits: DataFrame) -> DataFrame:
    """Search hits under the library's names, missing counts as 0."""
    kept = [c for c in ("archived", "fork") if c in hits.columns]
    return hits.select(
        "full_name", "html_url",
        _or_zero("stargazers_count").alias("stars"),
        _or_zero("forks_count").alias("forks"),
        _or_zero("watchers_count").alias("watchers"),
        _or_zero("open_issues_count").alias("open_issues"),
        _or_zero("size").alias("size_kb"),
        *kept,
    )


DEFAULTS: dict[str, object] = {
    **{c: 0 for c in (
        "stars", "forks", "watchers", "open_issues", "size_kb", "commit_count",
        "contributor_count", "release_count", "readme_length", "ai_keyword_count",
        "test_keyword_count", "intersection_phrase_count", "ai_dependency_count")},
    **{c: 0.0 for c in ("commits_per_month", "releases_per_year")},
    **{c: False for c in (
        "archived", "fork", "has_wiki", "has_pages", "has_discussions", "has_topics",
        "has_license", "has_description", "has_contributing", "has_code_of_conduct",
        "has_test_directory", "has_ci_config")},
    "description": "", "default_branch": "main",
}


def with_defaults(df: DataFrame) -> DataFrame:
    """The full enriched record: absent columns are added, absent values get their default.

    Counts and rates default to 0, flags to false, lists to empty; dates and ages stay NULL.
    """
    columns = []
    for field in schemas.ENRICHED.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.dataType.typeName() == "array":
            value = F.coalesce(value, F.array().cast(field.dataType))
        elif field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def repo_flags(details: DataFrame, as_of) -> DataFrame:
    """Ages, community flags, license and description of each repository's details."""
    topics = F.coalesce(F.col("topics"), F.array().cast("array<string>"))
    return details.select(
        "full_name", "created_at", "updated_at", "pushed_at",
        days_since("created_at", as_of).alias("days_since_created"),
        days_since("pushed_at", as_of).alias("days_since_last_push"),
        primary_language().alias("primary_language"),
        _or_false("has_wiki").alias("has_wiki"),
        _or_false("has_pages").alias("has_pages"),
        _or_false("has_discussions").alias("has_discussions"),
        topics.alias("topics"),
        (F.size(topics) > 0).alias("has_topics"),
        F.col("license").isNotNull().alias("has_license"),
        F.col("license.name").alias("license"),
        F.coalesce(F.length("description") > 0, F.lit(False)).alias("has_description"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("default_branch"), F.lit("main")).alias("default_branch"),
    )


def primary_language() -> Column:
    return F.col("language")


def basic_projection(hits: DataFrame) -> DataFrame:
    """The five columns kept when a run does not enrich."""
    return hits.select(
        "full_name", "html_url", F.col("stargazers_count").alias("stars"), "language", "description")


def taxonomy_stamp(df: DataFrame, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    return df.withColumn("taxonomy_version", F.lit(tax.version))
