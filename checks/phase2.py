"""Validation gates, funnel, README language and quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope import plans, taxonomy as tx
from corpuscope.functions import text as fx
from corpuscope.operators import files as fo, gates, language as lg, quality, validation as va

from .registry import cte, register, sq, sql_in, sql_list
from . import phase1  # noqa: F401  (its CTEs are used here)
from .views import LANGS

# -- tutorial rules ------------------------------------------------------------------

cte("texts", """
select full_name, coalesce(description, '') as description, topics_text,
  full_name || ' ' || coalesce(description, '') as text from {hits}""")
cte("tokens", """
select full_name, text, list_distinct(list_filter(list_concat(string_split_regex(lower(text), '[^a-z0-9]+'),
  case when coalesce(topics_text, '') = '' then [] else list_transform(string_split(topics_text, ','),
    lambda x: trim(lower(x))) end), lambda x: x <> '')) as toks from {texts}""")
_rules = "\n".join(
    f"when len(list_intersect(toks, {sql_list(fx.plural_forms(w))})) > 0 then [{sq(w)}, "
    f"list_min(list_intersect(toks, {sql_list(fx.plural_forms(w))}))]" for w in tx.TUTORIAL_WORDS)
_phrases = "\n".join(f"when contains(lower(text), {sq(p)}) then [{sq(p)}, {sq(p)}]" for p in tx.TUTORIAL_PHRASES)
cte("tutorial", f"select full_name, case {_rules}\n{_phrases} end as hit from {{tokens}}")


def _texts(v):
    return v.corpus.select("full_name", "topics", F.concat_ws(
        " ", "full_name", F.coalesce("description", F.lit(""))).alias("text"))


register("norm_tokens", lambda v: _texts(v).select(
    "full_name", F.explode(fx.norm_tokens("text", "topics")).alias("token")),
    "select full_name, unnest(toks) as token from {tokens}")
register("plural_forms", lambda v: _texts(v).select("full_name", F.explode(
    F.array_intersect(fx.norm_tokens("text", "topics"), fx.array_of(
        [f for w in tx.TUTORIAL_WORDS for f in fx.plural_forms(w)]))).alias("form")), f"""
select full_name, unnest(list_intersect(toks, {sql_list(
    [f for w in tx.TUTORIAL_WORDS for f in (w, w + 's', w + 'es') if w != 'lab' or f == 'lab'])})) as form
from {{tokens}}""")
register("tutorial_hit", lambda v: _texts(v).select(
    "full_name", fx.tutorial_hit("text", "topics").alias("h")).select("full_name", "h.keyword", "h.token"),
    "select full_name, hit[1] as keyword, hit[2] as token from {tutorial}")

# -- gates ---------------------------------------------------------------------------

LICENSED = f"coalesce(license in {sql_in(tx.ACCEPTED_LICENSES)}, false)"
INFRA = "(has_ci_config or has_test_directory)"

register("license_gate", lambda v: va.license_gate(v.enriched).select("full_name", "license"),
         f"select full_name, license from {{enriched}} where {LICENSED}")
register("infra_gate", lambda v: va.infra_gate(v.enriched).select("full_name", "has_ci_config", "has_test_directory"),
         f"select full_name, has_ci_config, has_test_directory from {{enriched}} where {INFRA}")
register("tutorial_gate", lambda v: va.tutorial_gate(v.corpus).select("full_name"),
         "select full_name from {tutorial} where hit is null")
cte("staged", f"""
select e.*, case when not {LICENSED} then 'license: not an accepted OSS license'
  when not {INFRA} then 'testing-infra: no CI/CD config and no test directory'
  when hit is not null then 'tutorial: ' || hit[1] || ' (matched ''' || hit[2] || ''')' end as exclusion_stage
from {{rated}} e left join {{tutorial}} t using (full_name)""")


def _rated(v):
    return gates.high_precision_filter(v.enriched)


def _staged(v):
    return va.stage_a(_rated(v))


register("stage_a", lambda v: _staged(v).select("full_name", "exclusion_stage"),
         "select full_name, exclusion_stage from {staged}")
register("survivors", lambda v: va.survivors(_staged(v)).select("full_name", "stars"),
         "select full_name, stars from {staged} where exclusion_stage is null")
register("excluded", lambda v: va.excluded(_staged(v)).select("full_name", "exclusion_stage"),
         "select full_name, exclusion_stage from {staged} where exclusion_stage is not null")
register("exclusion_reason", lambda v: va.excluded(_staged(v)).select(
    "full_name", fx.exclusion_reason("exclusion_stage").alias("reason")), """
select full_name, split_part(exclusion_stage, ':', 1) as reason from {staged} where exclusion_stage is not null""")
register("exclusion_breakdown", lambda v: va.exclusion_breakdown(va.excluded(_staged(v))), """
select split_part(exclusion_stage, ':', 1) as reason, count(*) as n from {staged}
where exclusion_stage is not null group by 1""")


def _union_excluded(v):
    a, b = va.license_ok(), va.infra_ok()
    _, no_license = va.split(v.enriched, a)
    licensed, _ = va.split(v.enriched, a)
    _, no_infra = va.split(licensed, b)
    return va.union_excluded((no_license, "license"), (no_infra, "testing-infra")).select(
        "full_name", "exclusion_stage")


register("union_excluded", _union_excluded, """
select full_name, split_part(exclusion_stage, ':', 1) as exclusion_stage from {staged}
where exclusion_stage like 'license%' or exclusion_stage like 'testing-infra%'""")
register("split", lambda v: (lambda kept, rest: kept.select("full_name", F.lit(True).alias("kept")).unionByName(
    rest.select("full_name", F.lit(False).alias("kept"))))(*va.split(v.details, F.col("has_wiki"))),
    "select full_name, coalesce(has_wiki, false) as kept from {details}")


def _funnel_sql(with_language: bool) -> str:
    conditions = [
        "true", "coalesce(exclusion_stage not like 'license%', true)",
        "coalesce(exclusion_stage not like 'license%' and exclusion_stage not like 'testing-infra%', true)",
        "exclusion_stage is null"]
    source = "{staged}"
    if with_language:
        conditions.append("exclusion_stage is null and (readme_lang is null or coalesce(readme_lang_conf, 1) >= 0.8)")
        source = "(select * from {staged} left join {readme_languages} using (full_name))"
    counts = ", ".join(f"count(*) filter (where {c}) as c{i}" for i, c in enumerate(conditions))
    lines = "\nunion all\n".join(
        f"select {i + 1}::bigint as step, {sq(va.STAGES[i])} as stage, c{i} as remaining, "
        f"c{max(i - 1, 0)} - c{i} as removed from counted" for i in range(len(conditions)))
    return f"select * from (with counted as (select {counts} from {source}) {lines})"


register("funnel", lambda v: va.funnel(_staged(v)), _funnel_sql(False))
register("corpus_profile", lambda v: va.corpus_profile(va.survivors(_staged(v))), """
select count(*) as n_repos, sum(has_ci_config::int)::bigint as n_ci, round(avg(has_ci_config::int) * 100, 6) as pct_ci,
  median(stars)::double as median_stars, round(avg(quality_score), 6) as mean_score
from {staged} where exclusion_stage is null""")

# -- README text ---------------------------------------------------------------------

# The given pages are the text with marks, URLs and lines in it.
cte("cleaned_pages", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'),
  '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[#>*\-_=|\[\]()!]+', ' ', 'g') as cleaned from {pages}""")
cte("cleaned", r"""
select full_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```', ' ', 'g'),
  '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[#>*\-_=|\[\]()!]+', ' ', 'g') as cleaned from {readmes}""")
register("clean_readme", lambda v: v.pages.select("page_id", fx.clean_readme("html").alias("cleaned")),
         "select page_id, cleaned from {cleaned_pages}")
register("text_lines", lambda v: v.pages.select("page_id", F.posexplode(
    fx.text_lines(fx.clean_readme("html"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")),
    r"""
select page_id, unnest(range(len(lines)))::bigint as line_no, unnest(lines) as line from (
  select page_id, list_filter(list_transform(string_split_regex(cleaned, '\r\n|\n|\r'), lambda x: trim(x, chr(32) || chr(9) || chr(160))),
    lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 20) as lines from {cleaned_pages})""")

# -- language ------------------------------------------------------------------------


def _folded(text: str) -> str:
    return (f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '[^\\pL]+', ' ', 'g'), "
            "'[^a-z ]', '~', 'g')) || ' '")


def _lp(lang: str) -> str:
    return (f"cast(round(ln((n_{lang} + 1) / (sum(n_{lang}) over () + {lg.ALPHABET_CUBED})::double) * {lg.SCALE})"
            f" as bigint) as lp_{lang}")


cte("profile", f"""
select trigram, {', '.join(_lp(x) for x in LANGS)} from (
  select trigram, {', '.join(f"count(*) filter (where lang = {sq(x)}) as n_{x}" for x in LANGS)} from (
    select lang, substr(f, unnest(range(1, length(f) - 1)), 3) as trigram
    from (select lang, {_folded('text')} as f from {{documents}})) group by 1)""")
cte("units", r"""
select full_name, len(lines) = 0 as whole, unnest(range(case when len(lines) = 0 then 1 else len(lines) end)) as line_no,
  unnest(case when len(lines) = 0 then [cleaned] else lines end) as line from (
  select full_name, cleaned, list_filter(list_transform(string_split_regex(cleaned, '\r\n|\n|\r'), lambda x: trim(x, chr(32) || chr(9) || chr(160))),
    lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 20) as lines from {cleaned})""")
cte("unit_scores", f"""
select full_name, whole, line_no, {', '.join(f'sum(lp_{x})::bigint as lp_{x}' for x in LANGS)} from (
  select full_name, whole, line_no, substr(f, unnest(range(1, length(f) - 1)), 3) as trigram
  from (select *, {_folded('line')} as f from {{units}})) join {{profile}} using (trigram) group by 1, 2, 3""")
BEST = "case " + " ".join(
    f"when {' and '.join([f'lp_{x} >= lp_{y}' for y in LANGS if y != x] or ['true'])} then {sq(x)}"
    for x in reversed(LANGS)) + " end"
cte("shares", f"""
select full_name, round(case when whole then case when p > 0.1 then p end else n_en / n_lines::double end, 6)
  as readme_lang_conf from (
  select full_name, bool_or(whole) as whole, count(*) as n_lines from {{units}} group by 1)
left join (select full_name, count(*) filter (where not whole and {BEST} = 'en') as n_en0,
  max(case when whole then 1.0 / ({' + '.join(f'exp(least((lp_{x} - lp_en) / 1000000.0::double, 700.0::double))' for x in LANGS)}) end) as p
  from {{unit_scores}} group by 1) s using (full_name),
lateral (select coalesce(n_en0, 0) as n_en)""")
cte("readme_languages", """
select full_name, readme_lang_conf,
  case when readme_lang_conf >= 0.8 then 'en' when readme_lang_conf is not null then 'non-en' end as readme_lang
from {shares}""")


def _profile(v):
    return lg.train_profile(v.documents, LANGS)


def _readme_language(v):
    return lg.corpus_readme_language(v.files, _profile(v), LANGS)


register("train_profile", _profile, "select * from {profile}")
register("line_language", lambda v: lg.line_language(fo.pick_readme(v.files), _profile(v), LANGS), f"""
select full_name, line_no, {BEST} as line_lang from (select full_name, line_no from {{units}} where not whole)
left join {{unit_scores}} using (full_name, line_no)""")
register("english_share", lambda v: lg.english_share(fo.pick_readme(v.files), _profile(v), LANGS),
         "select * from {shares}")
register("readme_language", lambda v: lg.readme_language(fo.pick_readme(v.files), _profile(v), LANGS),
         "select full_name, readme_lang, readme_lang_conf from {readme_languages}")
register("readme_lang", lambda v: _readme_language(v).select("full_name", "readme_lang"),
         "select full_name, readme_lang from {readme_languages}")
register("join_language", lambda v: va.join_language(va.survivors(_staged(v)), _readme_language(v)).select(
    "full_name", "readme_lang", "readme_lang_conf"), """
select full_name, readme_lang, readme_lang_conf from (select full_name from {staged} where exclusion_stage is null)
left join {readme_languages} using (full_name)""")
LANG_OK = "(readme_lang is null or coalesce(readme_lang_conf, 1) >= 0.8)"
register("language_gate", lambda v: va.language_gate(va.join_language(
    va.survivors(_staged(v)), _readme_language(v))).select("full_name"), f"""
select full_name from (select full_name from {{staged}} where exclusion_stage is null)
left join {{readme_languages}} using (full_name) where {LANG_OK}""")


def _validated(v):
    return plans.validate(_rated(v), v.files, v.documents, LANGS)


VALIDATE_SQL = f"""
select full_name, stars, readme_lang, true as phase2_pass from {{staged}} left join {{readme_languages}} using (full_name)
where exclusion_stage is null and {LANG_OK}"""
register("validate", lambda v: _validated(v).survivors.select("full_name", "stars", "readme_lang", "phase2_pass"), VALIDATE_SQL)
register("validation_funnel", lambda v: _validated(v).funnel, _funnel_sql(True))

# -- quality report ------------------------------------------------------------------

register("score_stats", lambda v: quality.score_stats(v.results), """
select round(avg(quality_score), 6) as mean, median(quality_score) as median, min(quality_score) as min,
  max(quality_score) as max, round(stddev_samp(quality_score), 6) as std,
  count(*) filter (where quality_score >= 20) as n_ge_20, count(*) filter (where quality_score >= 15) as n_ge_15
from {results}""")
register("star_stats", lambda v: quality.star_stats(v.results), """
select round(avg(stars), 6) as mean, median(stars)::double as median, min(stars) as min, max(stars) as max from {results}""")


def _with_gaps(v):
    """Search results under the report's names, with the gaps they really have."""
    return v.hits.select("full_name", "html_url", F.col("stargazers_count").alias("stars"),
                         F.col("forks_count").alias("forks"), F.col("watchers_count").alias("watchers"),
                         F.col("language").alias("primary_language"), "description")


_columns = {"stars": "stargazers_count", "forks": "forks_count", "watchers": "watchers_count",
            "primary_language": "language"}
COMPLETE = "\nunion all\n".join(
    f"select {sq(a)} as \"column\", count({b}) as \"count\", round(count({b}) / count(*)::double * 100, 2) as percentage from {{hits}}"
    for a, b in _columns.items())
register("completeness", lambda v: quality.completeness(_with_gaps(v)), COMPLETE)
register("mean_completeness", lambda v: quality.mean_completeness(_with_gaps(v)),
         f"select round(avg(percentage), 1) as mean_completeness from ({COMPLETE})")
register("structure_issues", lambda v: quality.structure_issues(v.results), """
select * from (
  select 'duplicate rows' as issue, 'full_name' as "column", sum(n)::bigint as n
  from (select count(*) as n from {results} group by full_name having count(*) > 1)
  union all select 'null values', 'html_url', count(*) from {results} where html_url is null
  union all select 'null values', 'full_name', count(*) from {results} where full_name is null
  union all select 'null values', 'stars', count(*) from {results} where stars is null) where n > 0""")
register("quality_issues", lambda v: quality.quality_issues(v.enriched), """
select * from (
  select 'low stars' as issue, count(*) as n from {enriched} where stars < 50
  union all select 'no description', count(*) from {enriched} where coalesce(description, '') = ''
  union all select 'not pushed for 2 years', count(*) from {enriched} where days_since_last_push > 730
  union all select 'no signals', count(*) from {enriched} where ai_keyword_count = 0 and test_keyword_count = 0)
where n > 0""")


REPORT = """total_repos bigint, structure_issues array<string>, quality_issues array<string>,
  enrichment_stats struct<total_repos bigint, enrichment_completeness map<string, struct<count bigint, percentage double>>,
  quality_scores struct<mean double, median double, min double, max double, std double>>"""


def read_report(text):
    """Every part of the JSON text as columns."""
    r, line = text.select(F.from_json("report", REPORT).alias("r")), lambda e: F.concat_ws(
        ":", e["key"], e["value"]["count"].cast("string"), F.format_number(e["value"]["percentage"], 2))
    stats = "r.enrichment_stats"
    return r.select(
        "r.total_repos", F.array_join("r.structure_issues", "|").alias("structure_issues"),
        F.array_join("r.quality_issues", "|").alias("quality_issues"), F.col(f"{stats}.total_repos").alias("n_stats"),
        F.array_join(F.transform(F.array_sort(F.map_entries(f"{stats}.enrichment_completeness")), line), "|").alias("complete"),
        *[f"{stats}.quality_scores.{c}" for c in ("mean", "median", "min", "max", "std")])


REPORT_SQL = """
select count(*) as total_repos,
  concat_ws('|', (select 'Found ' || sum(n)::bigint::varchar || ' duplicate repositories' from (select count(*) as n from {results}
    group by full_name having count(*) > 1)), case when count(*) filter (where html_url is null) > 0
    then 'Column ''html_url'' has ' || (count(*) filter (where html_url is null))::varchar || ' null values' end) as structure_issues,
  coalesce(case when count(*) filter (where stars < 50) > 0 then 'Found ' || (count(*) filter (where stars < 50))::varchar
    || ' repos with < 50 stars (below threshold)' end, '') as quality_issues, count(*) as n_stats,
  'primary_language:' || count(primary_language)::varchar || ':' || printf('%.2f', round(count(primary_language) / count(*)::double * 100, 2))
  || '|stars:' || count(stars)::varchar || ':' || printf('%.2f', round(count(stars) / count(*)::double * 100, 2)) as complete,
  round(avg(quality_score), 6) as mean, median(quality_score) as median, min(quality_score) as min, max(quality_score) as max,
  round(stddev_samp(quality_score), 6) as std
from {results}"""
register("report_json", lambda v: read_report(quality.report(v.results)), REPORT_SQL)
