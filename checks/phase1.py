"""Characteristics, gates and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope import plans, taxonomy as tx
from corpuscope.functions import dates, text as fx
from corpuscope.operators import files as fo, gates, ranking, repos, stats

from .registry import count_sql, cte, days_sql, register, sq, sql_in
from .views import AS_OF, TAX

# -- projections -----------------------------------------------------------------

register("normalize_repo", lambda v: repos.normalize_repo(v.hits), """
select full_name, html_url, coalesce(stargazers_count, 0) as stars, coalesce(forks_count, 0) as forks,
  coalesce(watchers_count, 0) as watchers, coalesce(open_issues_count, 0) as open_issues,
  coalesce(size, 0) as size_kb, archived, fork from {hits}""")

register("with_defaults", lambda v: repos.with_defaults(v.repo_details.drop("license")), """
select full_name, cast(null as varchar) as html_url, 0::bigint as stars, 0::bigint as forks,
  0::bigint as watchers, 0::bigint as open_issues, 0::bigint as size_kb, false as archived, false as fork,
  cast(created_at as varchar) as created_at, cast(updated_at as varchar) as updated_at,
  cast(pushed_at as varchar) as pushed_at, cast(null as bigint) as days_since_created,
  cast(null as bigint) as days_since_last_push, cast(null as varchar) as primary_language,
  coalesce(has_wiki, false) as has_wiki, has_pages, has_discussions,
  coalesce(replace(topics_text, ',', '|'), '') as topics, false as has_topics, false as has_license,
  cast(null as varchar) as license, false as has_description, coalesce(description, '') as description,
  coalesce(default_branch, 'main') as default_branch, 0::bigint as commit_count,
  0.0::double as commits_per_month, 0::bigint as contributor_count, 0::bigint as release_count,
  cast(null as bigint) as days_since_last_release, 0.0::double as releases_per_year,
  cast(null as varchar) as last_release_date, '' as language_distribution, 0::bigint as readme_length,
  0::bigint as ai_keyword_count, 0::bigint as test_keyword_count, 0::bigint as intersection_phrase_count,
  false as has_contributing, false as has_code_of_conduct, false as has_test_directory,
  false as has_ci_config, 0::bigint as ai_dependency_count from {details}""")

register("days_since", lambda v: v.commits.select(
    "commit_id", dates.days_since("committed_at", AS_OF).alias("days")), f"""
select commit_id, {days_sql('committed_at', AS_OF)} as days from {{commits}}""")

register("parse_iso", lambda v: v.events.select("event_id", dates.parse_iso(
    F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("parsed")), """
select event_id, strftime(date_trunc('second', ts) - interval '2' hour, '%Y-%m-%d %H:%M:%S') as parsed
from {events}""")

AGE = f"""select h.full_name, {days_sql('h.created_at', AS_OF)} as days, c.n as n_commits, r.n as n_releases
from {{hits}} h left join (select full_name, count(*) as n from {{commits}} group by 1) c using (full_name)
left join (select full_name, count(*) as n from {{releases}} group by 1) r using (full_name)"""
cte("ages", AGE)


def _ages(v):
    aged = v.hits.select("full_name", dates.days_since("created_at", AS_OF).alias("days"))
    return aged.join(stats.commit_stats(v.commits), "full_name", "left").join(
        stats.release_stats(v.releases, AS_OF), "full_name", "left")


register("commits_per_month", lambda v: _ages(v).select(
    "full_name", dates.commits_per_month("commit_count", "days").alias("commits_per_month")), """
select full_name, round(case when days > 0 then n_commits / (days / 30.0::double) else 0.0 end, 6)
  as commits_per_month from {ages}""")

register("releases_per_year", lambda v: _ages(v).select(
    "full_name", dates.releases_per_year("release_count", "days").alias("releases_per_year")), """
select full_name, round(case when days > 0 then n_releases / (days / 365.0::double) else 0.0 end, 6)
  as releases_per_year from {ages}""")

cte("flags", f"""
select full_name, created_at, updated_at, pushed_at, {days_sql('created_at', AS_OF)} as days_since_created,
  {days_sql('pushed_at', AS_OF)} as days_since_last_push, language as primary_language,
  coalesce(has_wiki, false) as has_wiki, has_pages, has_discussions,
  coalesce(replace(topics_text, ',', '|'), '') as topics, coalesce(topics_text <> '', false) as has_topics,
  license_name is not null as has_license, license_name as license,
  coalesce(description <> '', false) as has_description, coalesce(description, '') as description,
  coalesce(default_branch, 'main') as default_branch from {{details}}""")

register("repo_flags", lambda v: repos.repo_flags(v.repo_details, AS_OF), """
select * replace (cast(created_at as varchar) as created_at, cast(updated_at as varchar) as updated_at,
  cast(pushed_at as varchar) as pushed_at) from {flags}""")

register("primary_language", lambda v: v.repo_details.select(
    "full_name", repos.primary_language().alias("primary_language")),
    "select full_name, language as primary_language from {details}")

register("basic_projection", lambda v: repos.basic_projection(v.hits), """
select full_name, html_url, stargazers_count as stars, language, description from {hits}""")

register("taxonomy_stamp", lambda v: repos.taxonomy_stamp(v.hits.select("full_name"), TAX), f"""
select full_name, {sq(TAX.version)} as taxonomy_version from {{hits}}""")

# -- README text -------------------------------------------------------------------

register("readme_length", lambda v: v.hits.join(
    v.files.filter("path = 'README.md'"), "full_name", "left").select(
    "full_name", fx.readme_length("content").alias("readme_length")), """
select full_name, coalesce(length(content), 0)::bigint as readme_length
from {hits} left join (select full_name, content from {files} where path = 'README.md') f using (full_name)""")

for key, terms, source, ident, column in (
    ("keyword_count", TAX.testing_keywords + ("the", "ing", "en "), "conversations", "conv_id, turn", "text"),
    ("ai_keyword_count", TAX.ai_terms, "documents", "doc_id", "text"),
    ("test_keyword_count", TAX.readme_test_terms, "documents", "doc_id", "text"),
    ("intersection_phrase_count", TAX.phrases, "documents", "doc_id", "text"),
):
    register(key, lambda v, t=terms, s=source, i=ident, c=column: v.table(s).select(
        *i.split(", "), fx.keyword_count(c, t).alias("n")), f"""
select {ident}, cast({count_sql('l', terms)} as bigint) as n
from (select {ident}, lower({column}) as l from {{{source}}})""")

register("ai_dependency_count", lambda v: fo.ai_dependency_count(v.files, TAX), f"""
select full_name, cast(sum({" + ".join(f"contains(l, {sq(t.lower())})::bigint" for t in TAX.libraries)}) as bigint)
  as ai_dependency_count
from (select full_name, lower(content) as l from {{files}} where path in {sql_in(tx.MANIFEST_FILES)})
group by 1""")

register("top_languages", lambda v: ranking.top_languages(v.languages), """
select full_name, string_agg(language, '|' order by rn) as language_distribution from (
  select full_name, language, row_number() over (partition by full_name order by bytes desc, language) as rn
  from {languages}) where rn <= 3 group by 1""")

register("parse_topics", lambda v: v.hits.select("full_name", fx.parse_topics(
    F.when(F.col("topics_text").contains(","), F.concat(
        F.lit("['"), F.replace(F.col("topics_text"), F.lit(","), F.lit("', '")), F.lit("']")))
    .otherwise(F.col("topics_text"))).alias("topics")), """
select full_name, case when contains(topics_text, ',') then replace(topics_text, ',', '|') else '' end as topics
from {hits}""")

register("decode_content", lambda v: v.documents.select(
    "doc_id", fx.decode_content(F.base64(F.col("text").cast("binary"))).alias("decoded")),
    "select doc_id, text as decoded from {documents}")

# -- file presence ----------------------------------------------------------------


def _exists(path: str) -> str:
    return f"bool_or(path = {sq(path)} or starts_with(path, {sq(path + '/')}))"


def _is_dir(path: str) -> str:
    return f"bool_or((path = {sq(path)} and is_dir) or starts_with(path, {sq(path + '/')}))"


CI = " or ".join(_exists(p) for p in tx.CI_PATHS)
TEST_DIR = " or ".join(_is_dir(p) for p in tx.TEST_DIRECTORIES)

register("file_exists", lambda v: fo.file_exists(v.files, ".cursor/rules"),
         f"select full_name, {_exists('.cursor/rules')} as file_exists from {{files}} group by 1")
register("dir_exists", lambda v: fo.dir_exists(v.files, "tests"),
         f"select full_name, {_is_dir('tests')} as dir_exists from {{files}} group by 1")
register("has_documents", lambda v: fo.has_documents(v.files), f"""
select full_name, {_exists('CONTRIBUTING.md')} as has_contributing,
  {_exists('CODE_OF_CONDUCT.md')} as has_code_of_conduct from {{files}} group by 1""")
register("has_test_directory", lambda v: fo.has_test_directory(v.files),
         f"select full_name, {TEST_DIR} as has_test_directory from {{files}} group by 1")
register("has_ci_config", lambda v: fo.has_ci_config(v.files),
         f"select full_name, {CI} as has_ci_config from {{files}} group by 1")
cte("profile_files", f"""
select full_name, {_exists('CONTRIBUTING.md')} as has_contributing,
  {_exists('CODE_OF_CONDUCT.md')} as has_code_of_conduct, {TEST_DIR} as has_test_directory,
  {CI} as has_ci_config from {{files}} group by 1""")
register("files_profile", lambda v: fo.files_profile(v.files), "select * from {profile_files}")

cte("readmes", f"""
select full_name, arg_min(path, rank) as path, arg_min(content, rank) as content from (
  select full_name, path, content, list_position({'[' + ', '.join(sq(n) for n in tx.README_NAMES) + ']'}, path) as rank
  from {{files}} where path in {sql_in(tx.README_NAMES)}) group by 1""")
register("pick_readme", lambda v: fo.pick_readme(v.files), "select * from {readmes}")

# -- aggregates --------------------------------------------------------------------

register("commit_stats", lambda v: stats.commit_stats(v.commits),
         "select full_name, count(*) as commit_count from {commits} group by 1")
register("contributor_stats", lambda v: stats.contributor_stats(v.commits),
         "select full_name, count(distinct author_id) as contributor_count from {commits} group by 1")
register("release_stats", lambda v: stats.release_stats(v.releases, AS_OF), f"""
select full_name, count(*) as release_count, cast(max(published_at) as varchar) as last_release_date,
  {days_sql('max(published_at)', AS_OF)} as days_since_last_release from {{releases}} group by 1""")

# -- enrichment --------------------------------------------------------------------

cte("content_counts", f"""
select full_name,
  sum(case when path = 'README.md' then length(content) else 0 end)::bigint as readme_length,
  sum(case when path = 'README.md' then {count_sql('l', TAX.ai_terms)} else 0 end)::bigint as ai_keyword_count,
  sum(case when path = 'README.md' then {count_sql('l', TAX.readme_test_terms)} else 0 end)::bigint as test_keyword_count,
  sum(case when path = 'README.md' then {count_sql('l', TAX.phrases)} else 0 end)::bigint as intersection_phrase_count,
  sum({" + ".join(f"contains(l, {sq(t.lower())})::bigint" for t in TAX.libraries)})::bigint as ai_dependency_count
from (select full_name, path, content, lower(content) as l from {{files}} where path in {sql_in(tx.MANIFEST_FILES)})
group by 1""")
cte("top_langs", """
select full_name, string_agg(language, '|' order by rn) as language_distribution from (
  select full_name, language, row_number() over (partition by full_name order by bytes desc, language) as rn
  from {languages}) where rn <= 3 group by 1""")
cte("enriched", f"""
select h.full_name, h.html_url, h.stargazers_count as stars, coalesce(h.forks_count, 0) as forks,
  h.watchers_count as watchers, h.open_issues_count as open_issues, h.size as size_kb, h.archived, h.fork,
  f.created_at, f.updated_at, f.pushed_at, f.days_since_created, f.days_since_last_push, f.primary_language,
  f.has_wiki, f.has_pages, f.has_discussions, f.topics, f.has_topics, f.has_license, f.license,
  f.has_description, f.description, f.default_branch,
  coalesce(c.n, 0) as commit_count,
  coalesce(case when f.days_since_created > 0 then c.n / (f.days_since_created / 30.0::double) else 0.0 end, 0.0)
    as commits_per_month,
  coalesce(c.a, 0) as contributor_count, coalesce(r.n, 0) as release_count,
  {days_sql('r.last', AS_OF)} as days_since_last_release,
  coalesce(case when f.days_since_created > 0 then r.n / (f.days_since_created / 365.0::double) else 0.0 end, 0.0)
    as releases_per_year,
  r.last as last_release_date, coalesce(t.language_distribution, '') as language_distribution,
  coalesce(k.readme_length, 0) as readme_length, coalesce(k.ai_keyword_count, 0) as ai_keyword_count,
  coalesce(k.test_keyword_count, 0) as test_keyword_count,
  coalesce(k.intersection_phrase_count, 0) as intersection_phrase_count,
  coalesce(p.has_contributing, false) as has_contributing,
  coalesce(p.has_code_of_conduct, false) as has_code_of_conduct,
  coalesce(p.has_test_directory, false) as has_test_directory,
  coalesce(p.has_ci_config, false) as has_ci_config,
  coalesce(k.ai_dependency_count, 0) as ai_dependency_count
from {{hits}} h
left join {{flags}} f using (full_name)
left join (select full_name, count(*) as n, count(distinct author_id) as a from {{commits}} group by 1) c using (full_name)
left join (select full_name, count(*) as n, max(published_at) as last from {{releases}} group by 1) r using (full_name)
left join {{top_langs}} t using (full_name)
left join {{profile_files}} p using (full_name)
left join {{content_counts}} k using (full_name)""")
ENRICHED_OUT = """* replace (cast(created_at as varchar) as created_at, cast(updated_at as varchar) as updated_at,
  cast(pushed_at as varchar) as pushed_at, cast(last_release_date as varchar) as last_release_date,
  round(commits_per_month, 6) as commits_per_month, round(releases_per_year, 6) as releases_per_year)"""

register("enrich", lambda v: v.enriched, f"select {ENRICHED_OUT} from {{enriched}}")

# -- gates and score -------------------------------------------------------------

BASIC = "(stars >= 50 and coalesce(description, '') <> '' and not archived and not fork)"
CONTENT = """(readme_length >= 100 and ai_keyword_count + ai_dependency_count >= 1
  and (intersection_phrase_count > 0 or (ai_keyword_count + ai_dependency_count >= 2
    and test_keyword_count + has_test_directory::int + has_ci_config::int >= 1)))"""
ACTIVE = """(days_since_last_push is not null and days_since_last_push <= 730 and commit_count >= 1
  and contributor_count >= 1)"""
PARTS = {
    "popularity": """case when stars >= 10000 then 5 when stars >= 5000 then 4 when stars >= 1000 then 3
      when stars >= 500 then 2 when stars >= 100 then 1 else 0 end""",
    "activity": """case when coalesce(days_since_last_push, 9999) <= 30 then 3
      when coalesce(days_since_last_push, 9999) <= 90 then 2
      when coalesce(days_since_last_push, 9999) <= 365 then 1 else 0 end
      + case when commits_per_month >= 10 then 2 when commits_per_month >= 5 then 1 else 0 end""",
    "community": """case when contributor_count >= 50 then 2 when contributor_count >= 10 then 1 else 0 end
      + has_discussions::int + (open_issues > 0)::int + has_topics::int""",
    "documentation": """case when readme_length >= 1000 then 2 when readme_length >= 500 then 1 else 0 end
      + has_contributing::int + has_license::int + has_code_of_conduct::int""",
    "signals": """case when intersection_phrase_count >= 3 then 4 when intersection_phrase_count >= 1 then 2 else 0 end
      + case when ai_keyword_count >= 10 then 2 when ai_keyword_count >= 5 then 1 else 0 end
      + case when test_keyword_count >= 10 then 2 when test_keyword_count >= 5 then 1 else 0 end
      + (ai_dependency_count > 0)::int + has_test_directory::int""",
}
TOTAL = "least(" + " + ".join(f"({p})" for p in PARTS.values()) + ", 30)"

register("basic_filter", lambda v: gates.basic_filter(v.enriched).select("full_name", "stars"),
         f"select full_name, stars from {{enriched}} where {BASIC}")
register("simple_filter", lambda v: gates.simple_filter(v.hits).select("full_name", "stargazers_count"), """
select full_name, stargazers_count from {hits} where stargazers_count >= 50
  and coalesce(description, '') <> '' and not archived and not fork""")
register("content_filter", lambda v: gates.content_filter(v.enriched).select("full_name", "readme_length"),
         f"select full_name, readme_length from {{enriched}} where {CONTENT}")
register("activity_filter", lambda v: gates.activity_filter(v.enriched).select("full_name", "days_since_last_push"),
         f"select full_name, days_since_last_push from {{enriched}} where {ACTIVE}")
register("quality_score", lambda v: gates.quality_score(v.enriched).select("full_name", "quality_score"),
         f"select full_name, ({TOTAL})::double as quality_score from {{enriched}}")
register("score_components", lambda v: gates.score_components(v.enriched).select("full_name", *PARTS),
         "select full_name, " + ", ".join(f"({sql})::double as {k}" for k, sql in PARTS.items()) + " from {enriched}")
cte("rated", f"""
select *, case when {BASIC} and {CONTENT} and {ACTIVE} then ({TOTAL})::double else 0.0 end as quality_score
from {{enriched}}""")
register("high_precision_filter", lambda v: gates.high_precision_filter(v.enriched).select(
    "full_name", "quality_score", "passes"),
    "select full_name, quality_score::double as quality_score, quality_score >= 10 as passes from {rated}")

SIX = ("hits", "repo_details", "commits", "releases", "languages", "files")
register("mine", lambda v: plans.mine(*[getattr(v, t) for t in SIX], AS_OF, TAX), f"""
select {ENRICHED_OUT[:-1]}, quality_score::double as quality_score), {sq(TAX.version)} as taxonomy_version
from {{rated}} where quality_score >= 10""")
register("score_and_rank", lambda v: plans.score_and_rank(*[getattr(v, t) for t in SIX], AS_OF, TAX), """
select full_name, stars, commit_count, contributor_count, ai_keyword_count,
  round(commits_per_month, 6) as commits_per_month, quality_score::double as quality_score,
  quality_score >= 10 as passes from {rated}""")

# -- ranking and selection -------------------------------------------------------

cte("best", """
select * exclude (rn) from (select *, row_number() over (partition by full_name
  order by quality_score desc nulls last, stars desc nulls last, html_url asc nulls last) as rn from {results})
where rn = 1""")
register("dedup_best", lambda v: ranking.dedup_best(v.results), "select * from {best}")
register("sort_output", lambda v: ranking.sort_output(ranking.dedup_best(v.results)), """
select * from {best} order by quality_score desc nulls last, stars desc nulls last, full_name""")
register("select_top", lambda v: ranking.select_top(v.enriched, 25).select("full_name", "ai_keyword_count"), """
select full_name, ai_keyword_count from {enriched} order by ai_keyword_count desc, full_name limit 25""")
register("select_random", lambda v: ranking.select_random(v.hits, 25).select("full_name", "stargazers_count"), """
select full_name, stargazers_count from {hits} order by md5(full_name || '#42'), full_name limit 25""")
register("select_all", lambda v: ranking.select_all(v.hits).select("full_name", "html_url"),
         "select full_name, html_url from {hits}")
register("top_values", lambda v: ranking.top_values(v.enriched, "primary_language"), """
select primary_language as value, count(*) as n from {enriched} where primary_language is not null
group by 1 order by 2 desc, 1 limit 5""")
register("moving_avg_eta", lambda v: ranking.moving_avg_eta(v.job_log, block=1000).select(
    "run_id", "query_no", "avg_seconds", "remaining", "eta_seconds", "eta"), """
select run_id::bigint as run_id, query_no, round(a, 6) as avg_seconds, remaining, round(a * remaining, 6) as eta_seconds,
  case when query_no = 0 then 'calculating...'
    when a * remaining < 60 then trunc(a * remaining)::bigint || 's'
    when a * remaining < 3600 then trunc(a * remaining / 60)::bigint || 'm ' || trunc((a * remaining) % 60)::bigint || 's'
    else trunc(a * remaining / 3600)::bigint || 'h ' || trunc(((a * remaining) % 3600) / 60)::bigint || 'm' end as eta
from (select run_id, query_no, avg(seconds) over (partition by run_id order by query_no
    rows between 9 preceding and current row) as a,
  count(*) over (partition by run_id) - query_no - 1 as remaining from {job_log})""")
