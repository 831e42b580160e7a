"""Readers, writers and streams. Each query writes below the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from corpuscope import plans, schemas
from corpuscope.operators import mentions as mn, quality, validation as va
from corpuscope.session import shared_folder, written
from corpuscope.sources import readers, writers
from corpuscope.streaming import incremental as st

from .registry import register
from . import phase1, phase2, search
from .phase2 import _rated
from .phase3 import COLUMNS, _repos
from .views import AS_OF, LANGS, TAX

RESULT = T.StructType([
    T.StructField("full_name", T.StringType()), T.StructField("html_url", T.StringType()),
    T.StructField("stars", T.LongType()), T.StructField("quality_score", T.DoubleType()),
    T.StructField("primary_language", T.StringType()), T.StructField("topics", T.ArrayType(T.StringType()))])


def _read_repos(v):
    folder = shared_folder(v.spark, "repos")
    table = v.topics(v.details).drop("license_name")
    writers.flat(table).write.option("header", True).option("escape", '"').csv(folder)
    return readers.read_repos(v.spark, folder, table.schema)


register("read_repos", _read_repos, """
select full_name, cast(created_at as varchar) as created_at, cast(updated_at as varchar) as updated_at,
  cast(pushed_at as varchar) as pushed_at, language, has_wiki, has_pages, has_discussions,
  coalesce(replace(topics_text, ',', '|'), '') as topics, nullif(description, '') as description, default_branch
from {details}""")


def _read_repo_json(v):
    folder = shared_folder(v.spark, "pages")
    rows = v.hits.drop("created_at", "topics_text")
    # search pages hold at most 100 items
    paged = rows.withColumn("page", F.expr("cast(split_part(full_name, 'repo', -1) as bigint) div 100"))
    items = F.collect_list(F.struct(*rows.columns))
    paged.groupBy("page").agg(F.count("*").alias("total_count"), items.alias("items")).drop("page").write.json(folder)
    return readers.read_repo_json(v.spark, folder)


register("read_repo_json", _read_repo_json, """
select full_name, html_url, stargazers_count, forks_count, watchers_count, open_issues_count, size, archived, fork,
  language, description from {hits}""")


def _read_files(v):
    folder = shared_folder(v.spark, "files")
    encoded = v.files.withColumn("content", F.base64(F.col("content").cast("binary")))
    encoded.write.parquet(folder)
    return readers.decode_files(readers.read_files(v.spark, folder))


register("read_files", _read_files, "select full_name, path, is_dir, content from {files}")


def _write_repos(v):
    folder = shared_folder(v.spark, "out")
    table = v.results.withColumn("topics", F.array("primary_language", "full_name"))
    folders = writers.write_repos(table, folder)
    from_csv = readers.read_repos(v.spark, folders["csv"], RESULT)
    from_json = v.spark.read.schema(RESULT).json(folders["json"])
    return from_csv.withColumn("source", F.lit("csv")).unionByName(from_json.withColumn("source", F.lit("json")))


register("write_repos", _write_repos, """
select full_name, html_url, stars, quality_score, primary_language, primary_language || '|' || full_name as topics, source
from {best}, (select unnest(['csv', 'json']) as source)""")


def _append_mentions(v):
    folder = shared_folder(v.spark, "mentions")
    writers.append_mentions(mn.coauthor_trailers(v.commits), folder, "keywords")  # replaced below
    writers.append_mentions(mn.commit_mentions(v.commits, TAX), folder, "keywords")
    writers.append_mentions(mn.coauthor_trailers(v.commits), folder, "trailers")
    return readers.read_mentions(v.spark, folder)


register("append_mentions", _append_mentions, f"""
select {COLUMNS} from {{text_mentions}} where source_artifact = 'commit_message'
union all select {COLUMNS} from {{trailers}}""")


def _resumed(v):
    """Two runs, the first over some repositories and repeated, against one over all."""
    out, repos = shared_folder(v.spark, "resumed"), written(_repos(v), "repos")
    some = lambda t: t.filter(F.pmod(F.xxhash64("full_name"), F.lit(3)) == 0)
    for _ in range(2):
        plans.detect_run(repos, v.messages, v.files, out, "first", tax=TAX, select=some)
    plans.detect_run(repos, v.messages, v.files, out, "second", tax=TAX)
    return readers.read_mentions(v.spark, f"{out}/mentions")


register("detect_resumed", _resumed, f"select {COLUMNS} from {{all_mentions}}")


def _write_split(v):
    folder = writers.write_split(va.stage_a(_rated(v)), shared_folder(v.spark, "split"))
    return v.spark.read.parquet(folder).select("full_name", "exclusion_stage", "decision")


register("write_split", _write_split, """
select full_name, exclusion_stage, case when exclusion_stage is null then 'survivor' else 'excluded' end as decision
from {staged}""")


def _write_report(v):
    folder = writers.write_report(quality.report(v.results), shared_folder(v.spark, "report"))
    return phase2.read_report(v.spark.read.text(folder).withColumnRenamed("value", "report"))


register("write_report", _write_report, phase2.REPORT_SQL)


def _halves(key: str, half: int):
    """One half of a table, by a hash of a column."""
    return lambda t: t.filter(F.pmod(F.xxhash64(key), F.lit(2)) == half)


def _validate_resumed(v):
    """Two runs, the first over half of the repositories and repeated, against one over all."""
    # every run reads what was mined, and the profile of the same documents
    out, mined, profile = shared_folder(v.spark, "verdicts"), written(_rated(v), "mined"), written(phase2._profile(v), "profile")
    for _ in range(2):
        plans.validate_run(_halves("full_name", 0)(mined), v.files, v.documents, LANGS, out, "first", profile)
    found = plans.validate_run(mined, v.files, v.documents, LANGS, out, "second", profile)
    return found.survivors.select("full_name", "stars", "readme_lang", "phase2_pass")


register("validate_resumed", _validate_resumed, phase2.VALIDATE_SQL)


def _verdicts(v):
    out, mined, profile = shared_folder(v.spark, "verdicts"), written(_rated(v), "mined"), written(phase2._profile(v), "profile")
    for half in (0, 1):
        plans.validate_run(_halves("full_name", half)(mined), v.files, v.documents, LANGS, out, f"run {half}", profile)
    return readers.read_verdicts(v.spark, out)


register("append_verdicts", _verdicts, """
select full_name, readme_lang, readme_lang_conf from {readme_languages} join (
  select full_name from {staged} where exclusion_stage is null) using (full_name)""")


def _mine_resumed(v):
    """Two runs over halves of the plan, and one without work, against one over all."""
    out = shared_folder(v.spark, "mined")
    tables = [v.corpus, *[getattr(v, t) for t in phase1.SIX]]
    plans.mine_run(*tables, AS_OF, out, TAX, select=_halves("query_id", 0))
    plans.mine_run(*tables, AS_OF, out, TAX)
    return plans.mine_run(*tables, AS_OF, out, TAX).select(*search.MINED)


register("mine_resumed", _mine_resumed, search.MINED_SQL)

# -- streams -----------------------------------------------------------------------


def _landing(v, table, purpose: str, batches: int = 4):
    """The table as files in a landing folder, taken in by so many batches; a batch has a file a core."""
    folder = shared_folder(v.spark, purpose)
    cores = v.spark.sparkContext.defaultParallelism
    table.repartition(batches * cores).write.parquet(folder)
    return st.read_landing(v.spark, folder, table.schema, max_files=cores)


def _stream_detect(v):
    out, state = shared_folder(v.spark, "out"), shared_folder(v.spark, "state")
    stream = _landing(v, v.commits, "commits")
    # read again in every batch, so stored
    scanned = written(mn.scanned_repos(_repos(v), True), "scanned")
    st.stream_detect(stream, scanned, out, state, TAX).awaitTermination()
    return v.spark.read.schema(schemas.MENTIONS).parquet(out)


register("stream_detect", _stream_detect, f"""
select m.* replace (coalesce(m.testing_relevant, s.has_infra) as testing_relevant) from (
  select {COLUMNS} from {{text_mentions}} where source_artifact = 'commit_message'
  union all select {COLUMNS} from {{trailers}}) m join {{scanned}} s on m.repo_id = s.full_name""")


def _stream_dedup(v):
    out, state = shared_folder(v.spark, "out"), shared_folder(v.spark, "state")
    # arrivals of five days, so every repeat lies within the delay
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("commit_id"), F.lit(5 * 86_400)))
    stream = _landing(v, v.commits.select("full_name", arrived.alias("arrived_at")), "seen")
    st.stream_dedup(stream, out, state, "arrived_at", "7 days").awaitTermination()
    return v.spark.read.parquet(out).select("full_name")


register("stream_dedup", _stream_dedup, "select distinct full_name from {commits}")


def _stream_first_seen(v):
    out, state = shared_folder(v.spark, "out"), shared_folder(v.spark, "state")
    st.stream_first_seen(_landing(v, v.results, "seen"), out, state).awaitTermination()
    return st.read_first_seen(v.spark, out, v.results.schema).select("full_name")


register("stream_first_seen", _stream_first_seen, "select distinct full_name from {results}")


def _merge_best(v):
    out, state = shared_folder(v.spark, "out"), shared_folder(v.spark, "state")
    st.stream_merge_best(_landing(v, v.results, "results"), out, state).awaitTermination()
    return st.read_merged(v.spark, out, v.results.schema)


register("merge_best", _merge_best, "select * from {best}")
