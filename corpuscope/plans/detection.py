"""Phase 3: mentions and the summary per repository."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import taxonomy as tx
from ..operators.incremental import resume_anti_join
from ..operators.mentions import (
    detect_repo_mentions, repo_summary, run_summary, scanned_repos, skipped_catalogs)
from ..operators.ranking import select_all
from ..sources.readers import read_finished
from ..sources.writers import append_finished, append_mentions
from ..session import written


@dataclass(frozen=True)
class Detected:
    mentions: DataFrame
    summary: DataFrame
    totals: DataFrame
    skipped: DataFrame


def detect(repos: DataFrame, commits: DataFrame, files: DataFrame,
           done: DataFrame | None = None, tax: tx.Taxonomy = tx.DEFAULT,
           cap: int = 0, include_catalog: bool = False,
           select: Callable[[DataFrame], DataFrame] = select_all) -> Detected:
    """Mentions, summaries and totals; repositories in ``done`` are left out.

    ``select`` chooses among the repositories still to do (``select_top``, ``select_random``).
    All commits are read unless ``cap`` asks for the first ones of each repository only. Where
    repositories are left out, the texts of the others are picked before they are searched, which costs
    more than to move them.

    The mentions are written once: they are a result and what the summary is made from.
    """
    todo = select(repos if done is None else resume_anti_join(repos, done))
    if done is not None or select is not select_all:
        # stored, since several joins read it: only names, and Spark knows how many
        names = written(scanned_repos(todo, include_catalog).select("full_name").distinct(), "todo")
        commits, files = (t.join(names, "full_name", "left_semi") for t in (commits, files))
    mentions = written(
        detect_repo_mentions(todo, commits, files, tax, cap, include_catalog), "mentions")
    summary = repo_summary(mentions, scanned_repos(todo, include_catalog), commits, cap)
    return Detected(mentions, summary, run_summary(summary), skipped_catalogs(todo))


def detect_run(repos: DataFrame, commits: DataFrame, files: DataFrame, out: str, run: str,
               **options) -> Detected:
    """One resumable run below the folder ``out``: mentions first, then the finished repositories.

    Repositories that other runs have finished are left out. A run that died is repeated under
    its name and replaces what it had written.
    """
    done = read_finished(repos.sparkSession, f"{out}/finished", before=run)
    found = detect(repos, commits, files, done=done, **options)
    append_mentions(found.mentions, f"{out}/mentions", run)
    append_finished(found.summary, found.skipped, f"{out}/finished", run)
    return found
