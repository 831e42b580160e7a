"""Phase-3 detection: mentions of AI tools in commits, READMEs and configuration files.

Texts never travel: mentions are found where the text is read, and only the few mention
rows are joined and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import schemas, taxonomy as tx
from ..functions import text as fx
from .files import chosen_readme, present_artifacts, readme_files
from .ranking import top_k_per_group
from .validation import infra_ok

MENTION_COLUMNS = schemas.MENTIONS.fieldNames()

# Fixed fields of a mention that comes from a co-author trailer.
TRAILER = dict(
    artifact="commit_trailer", mention_type="direct-usage", context_type="ci_cd_integration",
    score=0.95, method="trailer", context_snippet="Co-authored-by trailer")


TRAILER_INDEX = -1


def _hits(df: DataFrame, text: str, tax: tx.Taxonomy, trailers: bool = False) -> DataFrame:
    """One row per (text, keyword) that occurs and, on request, one per co-author trailer.

    Every text is tested for plain substrings; the patterns run on the few candidates left,
    each known by its keyword's index (-1 for a trailer). Narrow, and one pass over the texts.

    Both filters read a column that an outer explode made. Spark copies a filter on an
    ordinary computed column (or one it infers for a plain explode) below the projection,
    which would do all the matching twice.
    """
    words, index = tax.genai_keywords, F.col("_index")
    candidates = fx.keyword_candidates("_folded", words)
    pos = fx.first_hit("scrubbed", F.get(fx.array_of([fx.bounded_pattern(w) for w in words]), index))
    keyword = F.get(fx.array_of(words), index)
    if trailers:
        none = F.array().cast("array<int>")
        candidates = F.when(
            F.lower(F.col(text)).contains("co-authored-by:"),
            F.array_append(F.coalesce(candidates, none), F.lit(TRAILER_INDEX))).otherwise(candidates)
        tool = fx.trailer_tool(text)
        pos = F.when(index == TRAILER_INDEX, F.when(tool.isNotNull(), 0)).otherwise(pos)
        keyword = F.when(index == TRAILER_INDEX, tool).otherwise(keyword)
    return (
        df.withColumn("scrubbed", fx.scrub(text))
        .withColumn("_folded", fx.fold_case("scrubbed"))
        .withColumn("_index", F.explode_outer(candidates)).filter(index.isNotNull()).drop("_folded")
        .withColumns({"keyword": keyword, "pos": F.explode_outer(F.array(pos))})
        .filter(F.col("pos").isNotNull())
    )


def keyword_positions(df: DataFrame, text: str, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Adds ``scrubbed``, ``keyword`` and ``pos``: one row per (text, keyword) that occurs.

    Only the first bounded hit of a keyword counts.
    """
    return _hits(df, text, tax).drop("_index")


def detect_mentions(df: DataFrame, artifact: str, text: str,
                    tax: tx.Taxonomy = tx.DEFAULT, date: Column | None = None,
                    provenance: Column | None = None, trailers: bool = False) -> DataFrame:
    """The eleven mention fields for the first hit of each keyword in each text. Narrow.

    With ``trailers`` the mentions of :func:`coauthor_trailers` come from the same pass.
    """
    date = F.lit(None) if date is None else date
    provenance = F.lit("") if provenance is None else provenance

    def pick(of_trailer, of_prose: Column) -> Column:
        if not trailers:
            return of_prose
        return F.when(F.col("_index") == TRAILER_INDEX, of_trailer).otherwise(of_prose)

    snippet = fx.clean_snippet(fx.context_window("scrubbed", "pos", "keyword"))
    related = fx.is_testing_related("context_snippet", F.lit(artifact), F.lit(False), "context_type")
    typed = (
        _hits(df, text, tax, trailers)
        .withColumns({
            "_date": date.cast("timestamp"), "_provenance": provenance,
            "context_snippet": pick(F.lit(TRAILER["context_snippet"]), snippet)})
        .withColumn("_lowered", F.lower("context_snippet"))  # once; some sixty cues read it
        .withColumn("context_type", pick(
            F.lit(TRAILER["context_type"]), fx.classify_context("context_snippet", "_lowered")))
        .withColumn("testing_relevant", pick(F.lit(None).cast("boolean"), related))
    )
    return typed.select(
        F.col("full_name").alias("repo_id"),
        pick(F.lit(TRAILER["artifact"]), F.lit(artifact)).alias("source_artifact"), "keyword",
        pick(F.lit(TRAILER["mention_type"]), fx.mention_type("context_snippet", "_lowered")).alias("mention_type"),
        "context_type", "testing_relevant",
        pick(F.lit(TRAILER["score"]), fx.confidence(
            F.lit(artifact), "context_type", "testing_relevant")).alias("confidence_score"),
        F.col("_date").alias("mention_date"),
        pick(F.lit(TRAILER["method"]), F.lit("keyword")).alias("detection_method"),
        F.col("_provenance").alias("provenance"), "context_snippet",
    )


def commit_mentions(commits: DataFrame, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    return detect_mentions(
        commits, "commit_message", "message", tax, F.col("committed_at"), F.col("commit_id"))


def commit_findings(commits: DataFrame, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Keyword mentions and co-author trailers from one scan of the commits."""
    return detect_mentions(
        commits, "commit_message", "message", tax, F.col("committed_at"), F.col("commit_id"),
        trailers=True)


def coauthor_trailers(commits: DataFrame) -> DataFrame:
    """Mentions from co-author trailers. ``testing_relevant`` waits for the repository."""
    found = commits.filter(F.lower(F.col("message")).contains("co-authored-by:"))
    return _structural(
        found.withColumn("_tool", fx.trailer_tool("message")).filter(F.col("_tool").isNotNull()),
        TRAILER["artifact"], F.col("_tool"), TRAILER["mention_type"], TRAILER["score"],
        TRAILER["method"], F.col("committed_at"), F.col("commit_id"), F.lit(TRAILER["context_snippet"]))


def config_artifacts(files: DataFrame) -> DataFrame:
    """One mention per agent-configuration path that a repository has."""
    return _structural(
        present_artifacts(files), "config_artifact", F.col("tool"), "tool-integration", 0.9,
        "artifact", F.lit(None), F.col("artifact"),
        F.concat(F.lit("present: "), F.col("artifact")))


def _structural(df: DataFrame, artifact: str, keyword: Column, kind: str, score: float,
                method: str, date: Column, provenance: Column, snippet: Column) -> DataFrame:
    return df.select(
        F.col("full_name").alias("repo_id"), F.lit(artifact).alias("source_artifact"),
        keyword.alias("keyword"), F.lit(kind).alias("mention_type"),
        F.lit(TRAILER["context_type"]).alias("context_type"),
        F.lit(None).cast("boolean").alias("testing_relevant"),
        F.lit(score).alias("confidence_score"), date.cast("timestamp").alias("mention_date"),
        F.lit(method).alias("detection_method"), provenance.alias("provenance"),
        snippet.alias("context_snippet"))


def readme_mentions(files: DataFrame, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Mentions in the README that counts for each repository.

    Every README variant is searched in place; which one counts is decided on paths alone,
    and only its mentions are kept.
    """
    found = detect_mentions(
        readme_files(files), "readme", "content", tax, provenance=F.col("path"))
    rank = F.lit(None).cast("int")
    for i, name in enumerate(tx.README_NAMES):
        rank = F.when(F.col("provenance") == name, i).otherwise(rank)
    chosen = chosen_readme(files).withColumnRenamed("full_name", "repo_id")
    return (
        found.withColumn("readme_rank", rank)
        .join(chosen, ["repo_id", "readme_rank"], "left_semi").select(*MENTION_COLUMNS)
    )


def catalog_flag(repos: DataFrame) -> DataFrame:
    """Adds ``repo_kind``: catalog for curated lists, else project."""
    return repos.withColumn(
        "repo_kind",
        F.when(fx.catalog_flag("full_name", "description", "topics"), "catalog").otherwise("project"))


def skipped_catalogs(repos: DataFrame) -> DataFrame:
    return catalog_flag(repos).filter(F.col("repo_kind") == "catalog").select(
        F.col("full_name").alias("repo_id"), F.lit("catalog/awesome-list").alias("reason"))


def commit_cutoffs(commits: DataFrame, cap: int) -> DataFrame:
    """Per repository its commit count and, above ``cap``, the last commit inside the cap.

    Columns: ``full_name, n_commits, cap_hit, cutoff_at, cutoff_id``. History order is
    (committed_at, commit_id), missing dates first. Only keys are read, in two scans.

    A repository may own a third of all commits, so its history is never sorted as one
    group. One count per repository and day gives the total, the day in which the cap falls
    and how much of that day is inside; only the commits of such days are ranked, in salted
    parts first.
    """
    day = F.coalesce(F.to_date("committed_at"), F.lit("0001-01-01").cast("date"))
    keyed = commits.select("full_name", "committed_at", "commit_id", day.alias("day"))
    # without commits of no repository, so that the joins below read the same counts again
    daily = keyed.filter(F.col("full_name").isNotNull()).groupBy("full_name", "day").agg(
        F.count("*").alias("n"))
    of_repo = W.partitionBy("full_name")
    history = of_repo.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    summed = daily.withColumns({
        "n_commits": F.sum("n").over(of_repo), "upto": F.sum("n").over(history)})
    per_repo = summed.groupBy("full_name").agg(F.max("n_commits").alias("n_commits"))
    boundary = summed.filter(
        (F.col("n_commits") > cap) & (F.col("upto") >= cap) & (F.col("upto") - F.col("n") < cap)
    ).select("full_name", "day", (F.lit(cap) - (F.col("upto") - F.col("n"))).alias("take"))
    order = [F.col("committed_at").asc_nulls_first(), F.col("commit_id")]
    cutoff = (
        top_k_per_group(keyed.join(boundary, ["full_name", "day"]), ["full_name"], order, cap,
                        spread=["commit_id"])
        .filter(F.col("rank") == F.col("take"))
        .select("full_name", F.col("committed_at").alias("cutoff_at"),
                F.col("commit_id").alias("cutoff_id"))
    )
    return per_repo.join(cutoff, "full_name", "left").withColumn(
        "cap_hit", F.col("n_commits") > cap
    ).select("full_name", "n_commits", "cap_hit", "cutoff_at", "cutoff_id")


def within_cap(date: str, commit_id: str) -> Column:
    """The commit is at or before its repository's cutoff, or there is none."""
    at, cut = F.col(date), F.col("cutoff_at")
    earlier = (at < cut) | (at.isNull() & cut.isNotNull())
    same = at.eqNullSafe(cut) & (F.col(commit_id) <= F.col("cutoff_id"))
    return F.col("cutoff_id").isNull() | F.coalesce(earlier, F.lit(False)) | same


def cap_commits(commits: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` commits of each repository in history order."""
    cut = commit_cutoffs(commits, cap).filter(F.col("cap_hit")).drop("n_commits", "cap_hit")
    return (
        commits.join(cut, "full_name", "left")
        .filter(within_cap("committed_at", "commit_id")).select(*commits.columns)
    )


def union_mentions(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scanned_repos(repos: DataFrame, include_catalog: bool = False) -> DataFrame:
    """``full_name, has_infra, repo_kind`` of the repositories to be searched."""
    kinds = catalog_flag(repos).select(
        "full_name", infra_ok().alias("has_infra"), "repo_kind")
    return kinds if include_catalog else kinds.filter(F.col("repo_kind") == "project")


def attach_repository(mentions: DataFrame, repos: DataFrame) -> DataFrame:
    """Keeps mentions of the given repositories and settles the structural ones' relevance."""
    infra = repos.select(F.col("full_name").alias("repo_id"), "has_infra")
    return mentions.join(infra, "repo_id").withColumn(
        "testing_relevant", F.coalesce(F.col("testing_relevant"), F.col("has_infra"))
    ).select(*MENTION_COLUMNS)


def detect_repo_mentions(repos: DataFrame, commits: DataFrame, files: DataFrame,
                         tax: tx.Taxonomy = tx.DEFAULT, cap: int = 0,
                         include_catalog: bool = False) -> DataFrame:
    """All mentions in the commits, README and files of each repository.

    A caller may ask for the first ``cap`` commits of each repository only. The cap and the
    repository's attributes are applied to mention rows, never to commits.
    """
    from_commits = commit_findings(commits, tax)
    if cap:
        cut = (
            commit_cutoffs(commits, cap).filter(F.col("cap_hit"))
            .select(F.col("full_name").alias("repo_id"), "cutoff_at", "cutoff_id")
        )
        from_commits = from_commits.join(cut, "repo_id", "left").filter(
            within_cap("mention_date", "provenance")).select(*MENTION_COLUMNS)
    found = union_mentions(from_commits, readme_mentions(files, tax), config_artifacts(files))
    return attach_repository(found, scanned_repos(repos, include_catalog))


def repo_summary(mentions: DataFrame, scanned: DataFrame, commits: DataFrame,
                 cap: int = 0) -> DataFrame:
    """One row per scanned repository, with zeros where nothing was found."""
    relevant = F.col("testing_relevant")
    found = mentions.groupBy(F.col("repo_id").alias("full_name")).agg(
        F.count("*").alias("n_mentions"),
        F.count_if(relevant).alias("n_testing_relevant"),
        F.min("mention_date").alias("first_mention_date"),
        F.min(F.when(relevant, F.col("mention_date"))).alias("first_testing_mention_date"),
        F.count_distinct("keyword").alias("distinct_tools"),
    )
    histories = commits.groupBy("full_name").agg(F.count("*").alias("n_commits"))
    commit_total = F.coalesce(F.col("n_commits"), F.lit(0))
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("long"))
              for c in ("n_mentions", "n_testing_relevant", "distinct_tools")}
    return (
        scanned.join(histories, "full_name", "left").join(found, "full_name", "left")
        .select(
            F.col("full_name").alias("repo_id"), "repo_kind",
            (F.least(commit_total, F.lit(cap)) if cap else commit_total).alias("n_commits_scanned"),
            ((commit_total > cap) if cap else F.lit(False)).alias("commit_cap_hit"),
            counts["n_mentions"].alias("n_mentions"),
            counts["n_testing_relevant"].alias("n_testing_relevant"),
            (counts["n_mentions"] > 0).alias("has_mention"),
            (counts["n_testing_relevant"] > 0).alias("has_testing_mention"),
            "first_mention_date", "first_testing_mention_date",
            counts["distinct_tools"].alias("distinct_tools"),
        )
    )


def run_summary(summary: DataFrame) -> DataFrame:
    """Repositories searched, those with a testing mention, and their share in percent."""
    hit = F.col("has_testing_mention").cast("long")
    return summary.agg(
        F.count("*").alias("n_repos"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_testing"),
        (F.avg(hit) * 100).alias("pct_testing"))
