"""Per-repository aggregates of the fact tables.

All of them combine on the map side, so a repository that owns a third of the rows sends
one row per task (or, for distinct counts, one per task and contributor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import days_since


def commit_stats(commits: DataFrame) -> DataFrame:
    return commits.groupBy("full_name").agg(F.count("*").alias("commit_count"))


def contributor_stats(commits: DataFrame) -> DataFrame:
    """Distinct authors per repository."""
    return commits.groupBy("full_name").agg(F.count_distinct("author_id").alias("contributor_count"))


def history_stats(commits: DataFrame) -> DataFrame:
    """Commits and distinct authors per repository from one scan."""
    return commits.groupBy("full_name").agg(
        F.count("*").alias("commit_count"), F.count_distinct("author_id").alias("contributor_count"))


def release_stats(releases: DataFrame, as_of) -> DataFrame:
    """Number of releases, latest one and its age."""
    return (
        releases.groupBy("full_name")
        .agg(F.count("*").alias("release_count"), F.max("published_at").alias("last_release_date"))
        .withColumn("days_since_last_release", days_since("last_release_date", as_of))
    )
