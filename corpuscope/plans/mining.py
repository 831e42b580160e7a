"""Phase 1: search, enrich, filter, rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from .. import taxonomy as tx
from ..operators.enrich import enrich
from ..operators.gates import high_precision_filter, hit_condition, simple_filter
from ..operators.incremental import resume_anti_join
from ..operators.ranking import dedup_best, select_all, sort_output
from ..operators.repos import basic_projection, taxonomy_stamp
from ..operators.shards import first_seen, shard_plan, shard_search, simple_plan, simple_search
from ..session import written
from ..sources.manifest import Manifest


def mine(hits: DataFrame, details: DataFrame, commits: DataFrame, releases: DataFrame,
         languages: DataFrame, files: DataFrame, as_of,
         tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Accepted repositories with all characteristics, best first.

    Hits that cannot pass (too few stars, archived, forks) leave before the joins. The best
    row per name is chosen before the verdict is read: a rejected row scores 0, so the
    outcome is the same, and the verdict, an expression over some twenty defaulted columns,
    is not pushed down into the joins, where deriving constraints from it would take the
    optimizer exponential time.
    """
    ready = enrich(hits.filter(hit_condition()), details, commits, releases, languages, files,
                   as_of, tax)
    best = dedup_best(high_precision_filter(ready)).filter("passes").drop("passes")
    return sort_output(taxonomy_stamp(best, tax))


def found_by_search(repos: DataFrame, tax: tx.Taxonomy = tx.DEFAULT, simple: bool = False,
                    done: DataFrame | None = None,
                    select: Callable[[DataFrame], DataFrame] = select_all) -> DataFrame:
    """``full_name, first_query_id`` of the repositories that a query of the plan finds.

    Queries in ``done`` (``query_id``) are left out; ``select`` chooses among the others.
    """
    spark = repos.sparkSession
    search, plan = (simple_search, simple_plan) if simple else (shard_search, shard_plan)
    return first_seen(search(repos, _still_to_do(plan(spark, tax), done, select), tax, ["full_name"]))


def _still_to_do(plan: DataFrame, done: DataFrame | None, select: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return select(plan if done is None else resume_anti_join(plan, done, ["query_id"]))


def mine_from_search(repos: DataFrame, hits: DataFrame, details: DataFrame, commits: DataFrame,
                     releases: DataFrame, languages: DataFrame, files: DataFrame, as_of,
                     tax: tx.Taxonomy = tx.DEFAULT, simple: bool = False) -> DataFrame:
    """Plan, search, first hit, enrichment, gates and best rows in one plan.

    ``repos`` is what the search looks at, ``hits`` what it returns of a repository. Only names
    and query numbers leave the search; ``first_query_id`` is kept beside the mined columns.
    """
    found = found_by_search(repos, tax, simple)
    mined = mine(hits.join(found, "full_name", "left_semi"), details, commits, releases, languages,
                 files, as_of, tax)
    return sort_output(mined.join(found, "full_name"))


FOUND = T.StructType([T.StructField("full_name", T.StringType()), T.StructField("first_query_id", T.LongType())])
QUERIES = T.StructType([T.StructField("query_id", T.LongType())])


def mine_run(repos: DataFrame, hits: DataFrame, details: DataFrame, commits: DataFrame,
             releases: DataFrame, languages: DataFrame, files: DataFrame, as_of, out: str,
             tax: tx.Taxonomy = tx.DEFAULT, simple: bool = False,
             select: Callable[[DataFrame], DataFrame] = select_all) -> DataFrame:
    """One resumable run of :func:`mine_from_search` below the folder ``out``; returns all results so far.

    Queries that earlier runs have finished are left out, ``select`` chooses among the others, and
    repositories that were found before are not mined again. Results, found names and finished
    queries become visible in one commit, so a run that died is simply repeated. Runs over all
    queries of a plan give what one run gives.
    """
    spark, manifest = repos.sparkSession, Manifest(repos.sparkSession, out)
    plan = (simple_plan if simple else shard_plan)(spark, tax)
    done = manifest.read(QUERIES, ["queries"])
    todo = written(_still_to_do(plan, done, select).select(F.col("query_id").cast("long")), "queries")
    chosen = lambda p: p.join(todo, "query_id", "left_semi")
    now = written(found_by_search(repos, tax, simple, select=chosen), "found")
    before = manifest.read(FOUND, ["found"])
    new = written(resume_anti_join(now, before).select("full_name"), "new")
    facts = [details, commits, releases, languages, files]
    if "found" in manifest.entries():  # a run that goes on: what earlier ones have mined is not added up again
        facts = [t.join(new, "full_name", "left_semi") for t in facts]
    mined = mine(hits.join(new, "full_name", "left_semi"), *facts, as_of, tax)
    old = manifest.read(mined.schema, ["results"])
    found = before.unionByName(now.select("full_name", F.col("first_query_id").cast("long").alias("first_query_id")))
    parts = {"results": old.unionByName(mined), "queries": done.unionByName(todo),
             "found": found.groupBy("full_name").agg(F.min("first_query_id").alias("first_query_id"))}
    entries = manifest.entries()
    for name, rows in parts.items():
        entries[name] = manifest.fresh(name)
        rows.write.parquet(f"{manifest.root}/{entries[name]}")
    manifest.commit(entries)
    return sort_output(manifest.read(mined.schema, ["results"]).join(manifest.read(FOUND, ["found"]), "full_name"))


def mine_basic(repos: DataFrame, hits: DataFrame, tax: tx.Taxonomy = tx.DEFAULT,
               simple: bool = False) -> DataFrame:
    """The run without enrichment: search, first hit, basic filter, five columns, best rows."""
    found = found_by_search(repos, tax, simple)
    rows = basic_projection(simple_filter(hits)).join(found, "full_name")
    return sort_output(dedup_best(rows))


def score_and_rank(hits: DataFrame, details: DataFrame, commits: DataFrame,
                   releases: DataFrame, languages: DataFrame, files: DataFrame, as_of,
                   tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Name, score and verdict of every repository, best first."""
    ready = enrich(hits, details, commits, releases, languages, files, as_of, tax)
    return sort_output(high_precision_filter(ready)).select(
        "full_name", "stars", "commit_count", "contributor_count", "ai_keyword_count",
        F.round("commits_per_month", 6).alias("commits_per_month"), "quality_score", "passes")
