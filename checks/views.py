"""Repository-shaped views over the given tables.

One SQL text per view, in the subset that Spark and DuckDB share, so both engines start
from the same rows. Every view covers its whole tables. Names in braces are the tables and
views it reads.
"""

from __future__ import annotations

import functools
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope import taxonomy as tx
from corpuscope.session import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Views that join or group whole tables and feed many queries, with the table whose rows they take over as
# they are. What they derive from their other tables is stored once per session, as the tables they stand
# for would be; the texts of that table are read where they lie.
STORED_VIEWS = {"files": "documents"}
TEXT_TABLES = ("documents", "pages", "conversations")

AS_OF = "2026-08-02 00:00:00"
LANGS = ("de", "en", "es", "fr")

# The given texts are invented prose, so README counts add word parts that occur in them.
TAX = replace(
    tx.DEFAULT,
    genai_keywords=tx.GENAI_KEYWORDS + ("thing", "tion"),
    libraries=tx.AI_LIBRARIES + ("erble",),
    phrases=tx.INTERSECTION_PHRASES + ("attion",),
    readme_test_terms=tx.README_TEST_TERMS + ("ertion",),
)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer input splits than cores, redistributed for CPU-heavy text work.

    The given tables are single small files; a table of many files comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def name(key: str) -> str:
    return (
        f"concat('org', cast({key} % 97 as string), "
        f"case when {key} % 41 = 0 then '/awesome-' when {key} % 37 = 0 then '/demo-' else '/' end, "
        f"'repo', cast({key} as string))"
    )


LANGUAGE = """case c_nationkey % 6 when 0 then 'Python' when 1 then 'Java' when 2 then 'JavaScript'
  when 3 then 'TypeScript' when 4 then 'Go' else 'Rust' end"""
CREATED = "cast(date '2008-01-01' + cast((c_custkey * 37) % 6700 as int) as timestamp)"
TOPICS = """case c_custkey % 5 when 0 then '' when 1 then 'ai,testing' when 2 then 'demo-app,Gemini'
  when 3 then 'lab, Tools ' end"""
DESCRIPTION = """case when c_custkey % 10 = 0 then null when c_custkey % 30 = 5 then ''
  when c_custkey % 17 = 0 then 'Demos and samples for JUnit'
  when c_custkey % 19 = 0 then 'A curated list of tools'
  when c_custkey % 13 = 0 then 'Hello World in Go'
  when c_custkey % 4 = 1 then 'Claude Code helper for Pytest and Selenium'
  when c_custkey % 4 = 2 then 'LLM-as-a-judge with ChatGPT for integration testing'
  when c_custkey % 4 = 3 then 'OpenAI wrapper, see labs'
  else concat('Tool ', c_name) end"""

PATH_NAMES = (
    "tests/test_main.py", "test/check.js", ".github/workflows/ci.yml", "CONTRIBUTING.md",
    "CODE_OF_CONDUCT.md", ".cursorrules", "CLAUDE.md", "package.json", "requirements.txt",
    ".travis.yml", "AGENTS.md", "pyproject.toml", ".circleci/config.yml",
    ".cursor/rules/main.mdc", ".cursor/rules/more.mdc", "README.txt", "tests",
) + tuple(f"src/module_{i}.py" for i in range(17, 60))
PATHS = ", ".join(f"(cast({i} as bigint), '{p}')" for i, p in enumerate(PATH_NAMES))

VIEWS: dict[str, str] = {
    "hits": f"""
select {name('c_custkey')} as full_name,
  concat('https://example.org/', {name('c_custkey')}) as html_url,
  cast(floor(abs(c_acctbal) * 1.25) as bigint) as stargazers_count,
  case when c_custkey % 19 = 0 then null else c_custkey % 53 end as forks_count,
  c_custkey % 31 as watchers_count, c_custkey % 7 as open_issues_count,
  cast(floor(abs(c_acctbal)) as bigint) % 5000 as size,
  c_custkey % 23 = 0 as archived, c_custkey % 29 = 0 as fork,
  {LANGUAGE} as language, {DESCRIPTION} as description,
  {CREATED} as created_at, {TOPICS} as topics_text
from {{customer}}""",
    "commits": f"""
select {name('o_custkey')} as full_name, md5(cast(o_orderkey as string)) as commit_id,
  cast(o_orderdate + interval '25' year as timestamp) as committed_at,
  concat('dev', cast(o_orderkey % 37 as string)) as author_id,
  case o_orderkey % 12
    when 0 then 'Add tests generated by ChatGPT for the parser'
    when 1 then 'We plan to use Claude Code for refactoring'
    when 2 then concat('Fix login flow', chr(10), chr(10), 'Co-authored-by: GitHub Copilot <bot@example.com>')
    when 3 then 'See https://example.org/openai/docs for details'
    when 4 then 'Switch model to GPT-4o in the ci pipeline'
    when 5 then 'Cursor'
    when 6 then concat('Used OpenAI and gpt-4 to fix flaky test', chr(10), 'in checkout   and', chr(9), 'basket')
    when 7 then 'Contact llama@example.org about the workflow of Mistral'
    when 8 then concat('A longer message that says a lot before it comes to its point about how a ',
      'gemini-based helper wrote the fixture for all of the checkout pages, and then goes on and on ', lower(o_orderpriority))
    when 9 then concat('Co-authored-by:', chr(10), ' someone and Claude ', o_orderpriority)
    else concat('Update ', lower(o_orderpriority)) end as message
from {{orders}}""",
    "pushes": "select full_name, max(committed_at) as pushed_at from {commits} group by full_name",
    "details": f"""
select h.full_name, h.created_at, p.pushed_at as updated_at, p.pushed_at, h.language,
  case when c % 19 = 0 then null else c % 3 = 0 end as has_wiki, c % 4 = 0 as has_pages,
  c % 2 = 0 as has_discussions, h.topics_text, h.description,
  case n % 6 when 0 then 'MIT License' when 1 then 'Apache License 2.0' when 2 then 'ISC License'
    when 3 then 'Other' when 5 then 'Mozilla Public License 2.0' end as license_name,
  case when c % 9 = 0 then null else 'main' end as default_branch
from (select {name('c_custkey')} as full_name, {CREATED} as created_at, {LANGUAGE} as language,
  {DESCRIPTION} as description, {TOPICS} as topics_text, c_custkey as c, c_nationkey as n
  from {{customer}}) h
left join {{pushes}} p on h.full_name = p.full_name""",
    "releases": f"""
select {name('o_custkey')} as full_name,
  cast(o_orderdate + interval '25' year as timestamp) as published_at
from {{orders}} where o_orderstatus = 'F'""",
    "languages": f"""
select {name('o_custkey')} as full_name, p_type as language, cast(sum(l_quantity) as bigint) as bytes
from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey join {{part}} on l_partkey = p_partkey
group by 1, 2""",
    "files": f"""
select {name('doc_id')} as full_name,
  case when doc_id % 11 = 0 then 'README.rst' when doc_id % 13 = 0 then 'readme.md'
    else 'README.md' end as path, false as is_dir, text as content
from {{documents}}
union all
select {name('k')} as full_name,
  p.path,
  slot = 16 as is_dir,
  case when slot = 7 and k % 3 = 0 then concat('"openai": "4.0",', chr(10), '"langchain": "0.1"')
    when slot = 8 and k % 2 = 0 then concat('OpenAI>=1', chr(10), 'transformers', chr(10), 'pytest')
    when slot = 11 then 'dependencies = "numpy, llama-index"'
    when slot = 15 then 'Tests of this thing use ChatGPT. Claude Code wrote the fixture.'
    else concat('content of ', cast(slot as string)) end as content
from (select distinct o_custkey as k, (l_partkey * 7 + l_suppkey) % 60 as slot
  from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey) s
join (values {PATHS}) p(place, path) on p.place = s.slot""",
    "results": f"""
select {name('o_custkey')} as full_name,
  case when o_orderkey % 45 = 0 then null
    else concat('https://example.org/', cast(o_orderkey as string)) end as html_url,
  cast(floor(o_totalprice / 1000) as bigint) as stars,
  case when o_orderkey % 50 = 0 then null else cast(o_orderkey % 31 as double) end as quality_score,
  o_orderstatus as primary_language
from {{orders}}""",
    "job_log": """
select 0 as run_id, event_id as query_no, value as seconds, (select count(*) from {events}) as total from {events}""",
}


def parts_of(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """The views as DataFrames, plus a few shapes the operators want."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @functools.cache
    def table(self, key: str) -> DataFrame:
        if key in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{key}.parquet")
            return spread(table) if key in TEXT_TABLES else table
        sql = VIEWS[key]
        parts = {p: self.table(p) for p in parts_of(sql)}
        if key not in STORED_VIEWS:
            return self.spark.sql(sql, **parts)
        none = {p: t.where(F.lit(False)) for p, t in parts.items()}
        large = STORED_VIEWS[key]
        taken = self.spark.sql(sql, **none | {large: parts[large]})
        derived = self.spark.sql(sql, **parts | {large: none[large]})
        # rows of a repository lie together, so that groups by it send one row each
        return taken.unionByName(written(derived.repartition("full_name"), key))

    def __getattr__(self, key: str) -> DataFrame:
        if key in TABLES or key in VIEWS:
            return self.table(key)
        raise AttributeError(key)

    @staticmethod
    def topics(df: DataFrame) -> DataFrame:
        empty = F.array().cast("array<string>")
        split = F.when(F.col("topics_text") == "", empty).otherwise(F.split("topics_text", ","))
        return df.withColumn("topics", split).drop("topics_text")

    @property
    def repo_details(self) -> DataFrame:
        licensed = F.when(F.col("license_name").isNotNull(), F.struct(F.col("license_name").alias("name")))
        return self.topics(self.details).withColumn("license", licensed).drop("license_name")

    @property
    def messages(self) -> DataFrame:
        """The commits, spread over the cores for the text operators."""
        return self.commits.repartition(self.spark.sparkContext.defaultParallelism) if (
            spread(self.orders) is not self.orders) else self.commits

    @property
    def corpus(self) -> DataFrame:
        """Search hits in the shape the shard search and the catalog rule read."""
        return self.topics(self.hits).withColumnsRenamed(
            {"stargazers_count": "stars", "forks_count": "forks"})

    @functools.cached_property
    def enriched(self) -> DataFrame:
        from corpuscope.operators.enrich import enrich
        return enrich(self.hits, self.repo_details, self.commits, self.releases, self.languages,
                      self.files, AS_OF, TAX)
