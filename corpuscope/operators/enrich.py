"""Joins the fact tables into one record of 30 characteristics per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import taxonomy as tx
from ..functions.dates import commits_per_month, releases_per_year
from .files import content_profile, files_profile
from .ranking import top_languages
from .repos import normalize_repo, repo_flags, with_defaults
from .stats import history_stats, release_stats


def enrich(hits: DataFrame, details: DataFrame, commits: DataFrame, releases: DataFrame,
           languages: DataFrame, files: DataFrame, as_of,
           tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """One enriched record per search hit; a side without a row gives the defaults.

    Every side is one row per repository before it joins, and all joins use the same key:
    the sides arrive already partitioned by it, so only the hits are shuffled once. No join
    has a hint; the adaptive planner broadcasts a side that turns out small. Feed unique
    hits (``first_seen`` or ``dedup_best``).
    """
    joined = normalize_repo(hits)
    for side in (
        repo_flags(details, as_of), history_stats(commits), release_stats(releases, as_of),
        top_languages(languages), files_profile(files), content_profile(files, tax),
    ):
        joined = joined.join(side, "full_name", "left")
    rated = joined.withColumns({
        "commits_per_month": commits_per_month("commit_count", "days_since_created"),
        "releases_per_year": releases_per_year("release_count", "days_since_created"),
    })
    return with_defaults(rated)
