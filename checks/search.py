"""Shard plan, its evaluation over the corpus, and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope import plans, taxonomy as tx
from corpuscope.operators import gates, shards

from .registry import cte, register, sq, sql_list
from . import phase1  # noqa: F401
from .views import AS_OF, TAX

cte("s_ai", f"select unnest({sql_list(TAX.genai_keywords)}) as term, unnest(range({len(TAX.genai_keywords)})) as ord1")
cte("s_test", f"select unnest({sql_list(TAX.testing_keywords)}) as other, unnest(range({len(TAX.testing_keywords)})) as ord2")
cte("s_lang", f"select unnest({sql_list(TAX.languages)}) as other, unnest(range({len(TAX.languages)})) as ord2")
cte("s_phrase", f"select unnest({sql_list(TAX.phrases)}) as term, unnest(range({len(TAX.phrases)})) as ord1")
cte("s_star", "select * from (values " + ", ".join(
    f"({i}, {lo}, {'null' if hi is None else hi}, "
    f"{sq(f'stars:>={lo}' if hi is None else f'stars:{lo}..{hi}')})" for i, (lo, hi) in enumerate(TAX.star_ranges))
    + ") t(shard, lo, hi, part)")
cte("s_time", "select * from (values " + ", ".join(
    f"({i}, date {sq(a)}, date {sq(b)}, {sq(f'created:{a}..{b} stars:>={TAX.min_stars}')})"
    for i, (a, b) in enumerate(TAX.time_shards)) + ") t(shard, d_lo, d_hi, part)")
cte("plan", f"""
select *, row_number() over (order by strategy_no, ord1, ord2, shard) - 1 as query_id from (
  select 1 as strategy_no, 'intersection' as strategy, ord1, ord2, shard, term, other,
    '"' || term || '" "' || other || '" ' || part as query, lo, hi, null::date as d_lo, null::date as d_hi
  from {{s_ai}}, {{s_test}}, {{s_star}}
  union all
  select 2, 'language', ord1, ord2, shard, term, other, '"' || term || '" language:' || other || ' ' || part, lo, hi, null, null
  from {{s_ai}}, {{s_lang}}, {{s_star}}
  union all
  select 3, 'phrase', ord1, 0, shard, term, '', '"' || term || '" ' || part, lo, hi, null, null
  from {{s_phrase}}, {{s_star}} where shard < {TAX.phrase_star_ranges}
  union all
  select 4, 'period', ord1, 0, shard, term, '', '"' || term || '" ' || part, {TAX.min_stars}, null, d_lo, d_hi
  from {{s_ai}}, {{s_time}} where ord1 < {TAX.time_keywords})""")
cte("searched", """
select *, lower(full_name || ' ' || coalesce(description, '') || ' ' || coalesce(replace(topics_text, ',', ' '), '')) as body
from {hits}""")
cte("found", """
select p.query_id, p.query, h.* from {plan} p join {searched} h on contains(h.body, lower(p.term))
  and (p.strategy <> 'intersection' or contains(h.body, lower(p.other)))
  and (p.strategy <> 'language' or h.language = p.other)
  and h.stargazers_count >= p.lo and (p.hi is null or h.stargazers_count <= p.hi)
  and (p.d_lo is null or cast(h.created_at as date) between p.d_lo and p.d_hi)""")


def _plan(v):
    return shards.shard_plan(v.spark, TAX)


def _found(v):
    return shards.shard_search(v.corpus, _plan(v), TAX)


def _seen_terms(v):
    """Keywords and phrases that occur somewhere in the corpus."""
    text = shards.search_text()
    terms = [*TAX.genai_keywords, *TAX.phrases]
    return v.corpus.select(F.explode(F.array_compact(F.array(*[
        F.when(text.contains(t.lower()), F.lit(t)) for t in terms]))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_repos"))


register("shard_plan", lambda v: _plan(v).join(_seen_terms(v), "term", "left").select(
    "query_id", "strategy", "term", "other", "query", "star_lo", "star_hi", "created_lo", "created_hi",
    F.coalesce("n_repos", F.lit(0)).alias("n_repos")), """
select query_id, strategy, p.term, other, query, case when strategy_no < 4 then lo end::bigint as star_lo,
  case when strategy_no < 4 then hi end::bigint as star_hi, cast(d_lo as varchar) as created_lo,
  cast(d_hi as varchar) as created_hi, coalesce(n_repos, 0) as n_repos
from {plan} p left join (select term, count(*) as n_repos from (select term from {s_ai} union all select term from {s_phrase})
  join {searched} on contains(body, lower(term)) group by 1) s on p.term = s.term""")
register("simple_plan", lambda v: shards.simple_plan(v.spark, TAX).join(
    F.broadcast(_seen_terms(v)), "term", "left").select("query_id", "query", F.coalesce("n_repos", F.lit(0)).alias("n_repos")), f"""
select ord1 as query_id, '"' || term || '" stars:>={TAX.min_stars}' as query, count(body) as n_repos
from {{s_ai}} left join {{searched}} on contains(body, lower(term)) group by 1, 2""")
register("shard_search", lambda v: _found(v).select("query_id", "query", "full_name"),
         "select query_id, query, full_name from {found}")
cte("found_simple", f"""
select ord1 as query_id, '"' || term || '" stars:>={TAX.min_stars}' as query, h.* from {{s_ai}}
join {{searched}} h on contains(h.body, lower(term)) and h.stargazers_count >= {TAX.min_stars}""")
register("simple_search", lambda v: shards.simple_search(v.corpus, shards.simple_plan(v.spark, TAX), TAX, ["full_name"]),
         "select query_id, query, full_name from {found_simple}")
MINED = ("full_name", "first_query_id", "stars", "quality_score", "ai_keyword_count", "commit_count", "taxonomy_version")
MINED_SQL = f"""
select r.full_name, q as first_query_id, stars, quality_score::double as quality_score, ai_keyword_count, commit_count,
  {sq(TAX.version)} as taxonomy_version
from {{rated}} r join (select full_name, min(query_id) as q from {{found}} group by 1) f on r.full_name = f.full_name
where quality_score >= 10"""
register("mine_from_search", lambda v: plans.mine_from_search(
    v.corpus, *[getattr(v, t) for t in phase1.SIX], AS_OF, TAX).select(*MINED), MINED_SQL)
for _key, _simple, _hits in (("mine_basic", False, "found"), ("mine_basic_simple", True, "found_simple")):
    register(_key, lambda v, simple=_simple: plans.mine_basic(v.corpus, v.hits, TAX, simple), f"""
select full_name, html_url, stargazers_count as stars, language, description, min(query_id) as first_query_id
from {{{{{_hits}}}}} where stargazers_count >= {tx.MIN_STARS} and coalesce(description, '') <> ''
  and not archived and not fork group by 1, 2, 3, 4, 5""".replace("{{", "{").replace("}}", "}"))
register("shard_predicate", lambda v: shards.shard_predicate(
    v.corpus, ["Claude", "Pytest"], 500, 5000, "Python", ("2010-01-01", "2024-12-31")).select("full_name", "stars"), """
select full_name, stargazers_count as stars from {searched} where contains(body, 'claude') and contains(body, 'pytest')
  and stargazers_count between 500 and 5000 and language = 'Python'
  and cast(created_at as date) between date '2010-01-01' and date '2024-12-31'""")


def _executed(v):
    """Every plan row once for each hit, and once without one, so queries repeat."""
    return _plan(v).join(_found(v).select("query_id", "full_name"), "query_id", "left")


cte("hits_of", "select p.query_id, p.query, count(f.query_id) as n_hits from {plan} p left join {found} f on p.query_id = f.query_id group by 1, 2")
register("dedup_queries", lambda v: shards.dedup_queries(_executed(v)).join(
    _found(v).groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id", "left").select(
    "query_id", "query", F.coalesce("n_hits", F.lit(0)).alias("n_hits")), "select * from {hits_of}")
register("query_stats", lambda v: shards.query_stats(shards.dedup_queries(_executed(v))), """
select count(*) as n_queries, count(*) filter (where contains(query, 'language:')) as with_language,
  count(*) filter (where contains(query, 'created:')) as with_period, count(*) filter (where contains(query, '..')) as with_range
from {hits_of}""")
register("first_seen", lambda v: shards.first_seen(_found(v)),
         "select full_name, min(query_id) as first_query_id from {found} group by 1")
register("search_topk", lambda v: shards.search_topk(_found(v), 10, "stars", True).select(
    "query_id", "full_name", "stars", "rank"), """
select query_id, full_name, stargazers_count as stars, rank from (select *, row_number() over (
  partition by query_id order by stargazers_count desc, full_name) as rank from {found}) where rank <= 10""")
register("shard_coverage", lambda v: shards.shard_coverage(_found(v), _plan(v), 20), """
select p.query_id, p.query, count(f.query_id) as n_hits, count(f.query_id) > 20 as truncated
from {plan} p left join {found} f on p.query_id = f.query_id group by 1, 2""")
cte("accepted", f"""
select full_name, min(query_id) as q from {{found}} where stargazers_count >= {tx.MIN_STARS}
  and coalesce(description, '') <> '' and not archived and not fork group by 1""")
cte("per_query", """
select f.query_id, f.n as found, coalesce(a.n, 0) as accepted from (select query_id, count(*) as n from {found} group by 1) f
left join (select q, count(*) as n from {accepted} group by 1) a on f.query_id = a.q""")
register("acceptance_stats", lambda v: shards.acceptance_stats(_found(v), gates.simple_filter(v.hits)), """
select * from {per_query} union all select -1, sum(found)::bigint, sum(accepted)::bigint from {per_query}""")
