"""Mentions of AI tools and the summary per repository."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuscope import plans, taxonomy as tx
from corpuscope.functions import text as fx
from corpuscope.operators import files as fo, incremental, mentions as mn

from .registry import cte, register, sq
from . import phase1  # noqa: F401
from .views import TAX

CAP = 8  # for the operators whose feature is a cap; the given histories are short


def _cases(text: str, classes, default: str) -> str:
    whens = " ".join(
        "when " + " or ".join(f"contains(lower({text}), {sq(c)})" for c in cues) + f" then {sq(name)}"
        for name, cues in classes)
    return f"case {whens} else {sq(default)} end"


def _class(text: str) -> str:
    return _cases(text, tx.CONTEXT_HINTS, "unspecified")


def _kind(text: str) -> str:
    return _cases(text, tx.MENTION_CUES, "reference")


def _testing(text: str) -> str:
    return f"regexp_matches({text}, {sq('(?i)' + tx.TESTING_TERMS)})"


def _scrub(text: str) -> str:
    return (f"regexp_replace(regexp_replace({text}, {sq(tx.URL)}, ' ', 'g'), {sq(tx.EMAIL)}, ' ', 'g')")


cte("text_sources", """
select full_name, 'commit_message' as artifact, message as body, committed_at as happened, commit_id as provenance from {commits}
union all
select full_name, 'readme', content, null, path from {readmes}""")
cte("scrubbed", f"select * exclude (body), {_scrub('body')} as t from {{text_sources}}")


def _bounded(keyword: str) -> tuple[str, str]:
    """Pattern of a bounded hit, and one whose first group is what stands in front of it."""
    word = re.escape(keyword)
    return (sq(f"(?i)(?:^|[^A-Za-z0-9]){word}(?:[^A-Za-z0-9]|$)"),
            sq(f"(?is)^(|.*?[^A-Za-z0-9]){word}(?:[^A-Za-z0-9]|$)"))


cte("bounded", "\nunion all\n".join(
    f"select *, {sq(k)} as keyword, length(regexp_extract(t, {_bounded(k)[1]}, 1)) as pos from {{scrubbed}} "
    f"where regexp_matches(t, {_bounded(k)[0]})" for k in TAX.genai_keywords))
cte("windowed", r"""
select *, substr(t, greatest(pos - 70, 0) + 1, least(pos, 70) + length(keyword) + 70) as raw from {bounded}""")
cte("snippets", r"""
select *, substr(trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0A-\x1F]', '', 'g'), '\s+', ' ', 'g')), 1, 200) as ctx
from {windowed}""")
cte("classified", f"""
select *, {_class('ctx')} as context_type, {_kind('ctx')} as mention_type,
  {_class('ctx')} <> 'unspecified' or {_testing('ctx')} as testing_relevant from {{snippets}}""")
cte("text_mentions", """
select full_name as repo_id, artifact as source_artifact, keyword, mention_type, context_type, testing_relevant,
  round(least(greatest(case artifact when 'commit_message' then 0.55::double else 0.5::double end
    + case when context_type <> 'unspecified' then 0.15::double else 0.0 end
    - case when testing_relevant then 0.0 else 0.2::double end, 0.05), 1.0), 2) as confidence_score,
  cast(happened as varchar) as mention_date, 'keyword' as detection_method, provenance, ctx as context_snippet
from {classified}""")
TOOL = f"regexp_extract(message, {sq('(?i)' + tx.TRAILER)}, 1)"
cte("trailers", f"""
select full_name as repo_id, 'commit_trailer' as source_artifact, {TOOL} as keyword,
  'direct-usage' as mention_type, 'ci_cd_integration' as context_type, cast(null as boolean) as testing_relevant,
  0.95::double as confidence_score, cast(committed_at as varchar) as mention_date, 'trailer' as detection_method,
  commit_id as provenance, 'Co-authored-by trailer' as context_snippet from {{commits}} where {TOOL} <> ''""")
_artifact = "case " + " ".join(
    f"when path = {sq(p)} or starts_with(path, {sq(p + '/')}) then {sq(p)}" for p, _ in tx.CONFIG_ARTIFACTS) + " end"
_tool = "case artifact " + " ".join(f"when {sq(p)} then {sq(t)}" for p, t in tx.CONFIG_ARTIFACTS) + " end"
cte("configs", f"""
select full_name as repo_id, 'config_artifact' as source_artifact, {_tool} as keyword, 'tool-integration' as mention_type,
  'ci_cd_integration' as context_type, cast(null as boolean) as testing_relevant, 0.9::double as confidence_score,
  cast(null as varchar) as mention_date, 'artifact' as detection_method, artifact as provenance,
  'present: ' || artifact as context_snippet
from (select distinct full_name, {_artifact} as artifact from {{files}}) where artifact is not null""")
COLUMNS = ", ".join(mn.MENTION_COLUMNS)


def _commit_hits(v):
    return mn.keyword_positions(v.messages.select("commit_id", "message"), "message", TAX)


def _contexts(v):
    return _commit_hits(v).withColumn("context", fx.context_window("scrubbed", "pos", "keyword"))


register("scrub", lambda v: v.documents.select("doc_id", fx.scrub("text").alias("scrubbed")),
         f"select doc_id, {_scrub('text')} as scrubbed from {{documents}}")
register("keyword_hits", lambda v: _commit_hits(v).select("commit_id", "keyword", F.col("pos").cast("long").alias("pos")), """
select provenance as commit_id, keyword, pos from {bounded} where artifact = 'commit_message'""")
register("context_window", lambda v: _contexts(v).select("commit_id", "keyword", "context"), """
select provenance as commit_id, keyword, raw as context from {windowed} where artifact = 'commit_message'""")
register("clean_snippet", lambda v: _contexts(v).select("commit_id", "keyword", fx.clean_snippet("context").alias("snippet")), """
select provenance as commit_id, keyword, ctx as snippet from {snippets} where artifact = 'commit_message'""")
register("classify_context", lambda v: v.commits.select("commit_id", fx.classify_context("message").alias("context_type")),
         f"select commit_id, {_class('message')} as context_type from {{commits}}")
register("mention_type", lambda v: v.commits.select("commit_id", fx.mention_type("message").alias("mention_type")),
         f"select commit_id, {_kind('message')} as mention_type from {{commits}}")


def _judged(v):
    infra = fo.files_profile(v.files).select("full_name", (F.col("has_ci_config") | F.col("has_test_directory")).alias("infra"))
    kinds = v.commits.withColumn("artifact", F.when(fx.trailer_tool("message").isNotNull(), "commit_trailer").otherwise("commit_message"))
    return kinds.join(infra, "full_name", "left").withColumn(
        "related", fx.is_testing_related("message", "artifact", "infra"))


cte("judged", f"""
select commit_id, message, case when {TOOL} <> '' then 'commit_trailer' else 'commit_message' end as artifact,
  {_class('message')} <> 'unspecified' or {_testing('message')}
    or ({TOOL} <> '' and coalesce(has_ci_config or has_test_directory, false)) as related
from {{commits}} left join {{profile_files}} using (full_name)""")
register("is_testing_related", lambda v: _judged(v).select("commit_id", "related"),
         "select commit_id, related from {judged}")
register("confidence", lambda v: _judged(v).select(
    "commit_id", fx.confidence("artifact", fx.classify_context("message"), "related").alias("confidence")), f"""
select commit_id, round(least(greatest(case artifact when 'commit_trailer' then 0.9::double else 0.55::double end
  + case when {_class('message')} <> 'unspecified' then 0.15::double else 0.0 end
  - case when related then 0.0 else 0.2::double end, 0.05), 1.0), 2) as confidence from {{judged}}""")
register("coauthor_trailers", lambda v: mn.coauthor_trailers(v.commits), f"select {COLUMNS} from {{trailers}}")
register("config_artifacts", lambda v: mn.config_artifacts(v.files), f"select {COLUMNS} from {{configs}}")
register("commit_mentions", lambda v: mn.commit_mentions(v.messages, TAX), f"""
select {COLUMNS} from {{text_mentions}} where source_artifact = 'commit_message'""")
register("commit_findings", lambda v: mn.commit_findings(v.messages, TAX), f"""
select {COLUMNS} from {{text_mentions}} where source_artifact = 'commit_message'
union all select {COLUMNS} from {{trailers}}""")
register("readme_mentions", lambda v: mn.readme_mentions(v.files, TAX), f"""
select {COLUMNS} from {{text_mentions}} where source_artifact = 'readme'""")
cte("talks", f"select conv_id, turn, {_scrub('text')} as t from {{conversations}}")
cte("talk_hits", "\nunion all\n".join(
    f"select *, {sq(k)} as keyword, length(regexp_extract(t, {_bounded(k)[1]}, 1)) as pos from {{talks}} "
    f"where regexp_matches(t, {_bounded(k)[0]})" for k in TAX.genai_keywords))
cte("talk_windows", r"""
select *, substr(trim(regexp_replace(regexp_replace(substr(t, greatest(pos - 70, 0) + 1, least(pos, 70) + length(keyword) + 70),
  '[\x00-\x08\x0A-\x1F]', '', 'g'), '\s+', ' ', 'g')), 1, 200) as ctx from {talk_hits}""")
cte("talk_mentions", f"""
select conv_id::varchar as repo_id, 'conversation' as source_artifact, keyword, {_kind('ctx')} as mention_type,
  {_class('ctx')} as context_type, {_class('ctx')} <> 'unspecified' or {_testing('ctx')} as testing_relevant,
  round(least(greatest(0.5::double + case when {_class('ctx')} <> 'unspecified' then 0.15::double else 0.0 end
    - case when {_class('ctx')} <> 'unspecified' or {_testing('ctx')} then 0.0 else 0.2::double end, 0.05), 1.0), 2) as confidence_score,
  cast(null as varchar) as mention_date, 'keyword' as detection_method, turn::varchar as provenance, ctx as context_snippet
from {{talk_windows}}""")
register("detect_mentions", lambda v: mn.detect_mentions(
    v.conversations.withColumn("full_name", F.col("conv_id").cast("string")), "conversation", "text", TAX,
    provenance=F.col("turn").cast("string")), f"select {COLUMNS} from {{talk_mentions}}")
register("union_mentions", lambda v: mn.union_mentions(
    mn.commit_mentions(v.messages, TAX), mn.coauthor_trailers(v.commits), mn.readme_mentions(v.files, TAX),
    mn.config_artifacts(v.files)), f"""
select {COLUMNS} from {{text_mentions}} union all select {COLUMNS} from {{trailers}}
union all select {COLUMNS} from {{configs}}""")

# -- catalogs, cap, repositories ---------------------------------------------------

cte("kinds", f"""
select full_name, case when regexp_matches(lower(full_name), {sq(tx.CATALOG_NAME)})
  or regexp_matches(coalesce(description, '') || ' ' || coalesce(topics_text, ''), {sq('(?i)' + tx.CATALOG_TEXT)})
  then 'catalog' else 'project' end as repo_kind from {{hits}}""")
register("catalog_flag", lambda v: mn.catalog_flag(v.corpus).select("full_name", "repo_kind"), "select * from {kinds}")
register("skipped_catalogs", lambda v: mn.skipped_catalogs(v.corpus), """
select full_name as repo_id, 'catalog/awesome-list' as reason from {kinds} where repo_kind = 'catalog'""")
cte("capped", f"""
select * from (select *, row_number() over (partition by full_name order by committed_at, commit_id) as rn,
  count(*) over (partition by full_name) as n_commits from {{commits}}) where rn <= {CAP}""")
register("cap_commits", lambda v: mn.cap_commits(v.commits, CAP).select("full_name", "commit_id", "message"),
         "select full_name, commit_id, message from {capped}")
register("commit_cutoffs", lambda v: mn.commit_cutoffs(v.commits, CAP), f"""
select full_name, n_commits, n_commits > {CAP} as cap_hit,
  case when n_commits > {CAP} then cast(committed_at as varchar) end as cutoff_at,
  case when n_commits > {CAP} then commit_id end as cutoff_id
from {{capped}} where rn = least(n_commits, {CAP})""")


def _repos(v):
    flags = fo.files_profile(v.files).select("full_name", "has_ci_config", "has_test_directory")
    return v.corpus.join(flags, "full_name", "left")


cte("scanned", """
select full_name, repo_kind, coalesce(has_ci_config or has_test_directory, false) as has_infra
from {kinds} left join {profile_files} using (full_name)""")
cte("all_mentions", f"""
select m.* replace (coalesce(m.testing_relevant, s.has_infra) as testing_relevant) from (
  select {COLUMNS} from {{text_mentions}}
  union all select {COLUMNS} from {{trailers}}
  union all select {COLUMNS} from {{configs}}) m
join {{scanned}} s on m.repo_id = s.full_name
where s.repo_kind = 'project'""")
register("detect_repo_mentions", lambda v: mn.detect_repo_mentions(_repos(v), v.messages, v.files, TAX),
         f"select {COLUMNS} from {{all_mentions}}")
register("scanned_repos", lambda v: mn.scanned_repos(_repos(v), include_catalog=True), "select * from {scanned}")
cte("summary", f"""
select s.full_name as repo_id, s.repo_kind, coalesce(c.n, 0)::bigint as n_commits_scanned,
  false as commit_cap_hit, coalesce(m.n, 0) as n_mentions, coalesce(m.r, 0) as n_testing_relevant,
  coalesce(m.n, 0) > 0 as has_mention, coalesce(m.r, 0) > 0 as has_testing_mention,
  m.first_mention_date, m.first_testing_mention_date, coalesce(m.tools, 0) as distinct_tools
from {{scanned}} s
left join (select full_name, count(*) as n from {{commits}} group by 1) c using (full_name)
left join (select repo_id as full_name, count(*) as n, count(*) filter (where testing_relevant) as r,
  min(mention_date) as first_mention_date, min(mention_date) filter (where testing_relevant) as first_testing_mention_date,
  count(distinct keyword) as tools from {{all_mentions}} group by 1) m using (full_name)
where s.repo_kind = 'project'""")


def _detected(v):
    return plans.detect(_repos(v), v.messages, v.files, tax=TAX)


register("repo_summary", lambda v: _detected(v).summary, "select * from {summary}")
register("run_summary", lambda v: _detected(v).totals, """
select count(*) as n_repos, sum(has_testing_mention::int)::bigint as n_testing,
  round(avg(has_testing_mention::int) * 100, 6) as pct_testing from {summary}""")


def _done(v):
    return v.releases.select("full_name").distinct()


register("resume_anti_join", lambda v: incremental.resume_anti_join(v.hits, _done(v)).select("full_name"), """
select full_name from {hits} where full_name not in (select full_name from {releases})""")
