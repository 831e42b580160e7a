"""Physical plans of the operators: pruned and filtered scans, few shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from .conftest import SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _table(spark, tmp_path, rows, schema):
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def test_presence_scan_does_not_read_contents(spark, tmp_path):
    from corpuscope import schemas
    from corpuscope.operators import files as fo
    files = _table(spark, tmp_path, [("a/b", "tests/x", False, "text")], schemas.FILES)
    assert "content" not in plan_of(fo.files_profile(files)).split("ReadSchema")[1]
    assert "In(path" in plan_of(fo.content_profile(files))


def test_cutoffs_do_not_read_messages(spark, tmp_path):
    from corpuscope import schemas
    from corpuscope.operators import mentions as mn
    commits = _table(spark, tmp_path, [], schemas.COMMITS)
    assert "message" not in plan_of(mn.commit_cutoffs(commits, 10))


def test_rank_limits_run_before_the_shuffle(spark, tmp_path):
    from corpuscope.operators import ranking, shards
    df = spark.range(100_000).selectExpr(
        "cast(id % 3 as string) as full_name", "id as stars", "id % 2 as query_id")
    assert plan_of(ranking.dedup_best(df)).count("WindowGroupLimit") == 2
    # twice, before and after the shuffle, for the salted parts and for the groups
    assert plan_of(shards.search_topk(df, 1000)).count("WindowGroupLimit") == 4


def test_enrich_shuffles_the_hits_once(spark):
    from checks.registry import views
    v = views(spark, SMALL)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        from checks.views import AS_OF, TAX
        from corpuscope.operators.enrich import enrich
        plan = plan_of(enrich(v.hits, v.repo_details, v.commits, v.releases, v.languages, v.files, AS_OF, TAX))
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
    joins = len(re.findall(r"SortMergeJoin \[full_name", plan))
    exchanges = len(re.findall(r"Exchange hashpartitioning\(full_name#\d+, 8\)", plan))
    # one for the hits, and at most one that brings in each further side; files lie in buckets already
    assert joins >= 6 and exchanges <= joins + 1


def _plain_plan(spark, make) -> str:
    """The plan without adaptive execution, in which reused exchanges are shown, and without broadcasts."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, value in zip(old, ("-1", "false")):
            spark.conf.set(k, value)
        return plan_of(make())
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)


def test_cutoffs_read_the_commits_twice(spark, tmp_path):
    from corpuscope import schemas
    from corpuscope.operators import mentions as mn
    commits = _table(spark, tmp_path, [], schemas.COMMITS)
    assert _plain_plan(spark, lambda: mn.commit_cutoffs(commits, 10)).count("FileScan parquet") == 2


def test_tutorial_rules_are_planned_once(spark, tmp_path):
    from corpuscope import taxonomy as tx
    from corpuscope.operators import validation as va
    schema = ("full_name string, description string, topics array<string>, license string, "
              "has_ci_config boolean, has_test_directory boolean")
    staged = va.stage_a(_table(spark, tmp_path, [], schema))
    for df in (va.survivors(staged), va.excluded(staged)):
        assert plan_of(df).count("arrays_overlap(") == len(tx.TUTORIAL_WORDS)


def test_scoring_readmes_moves_no_text(spark, tmp_path):
    from corpuscope import schemas
    from corpuscope.operators import language as lg
    files = _table(spark, tmp_path, [("a/b", "README.md", False, "text")], schemas.FILES)
    profile = spark.createDataFrame([("abc", 1, 2)], "trigram string, lp_de long, lp_en long")
    plan = _plain_plan(spark, lambda: lg.corpus_readme_language(files, profile, ["de", "en"]))
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line


def test_medians_count_before_they_rank(spark):
    from corpuscope.operators import quality
    rows = [(float(i % 101) if i % 7 else None,) for i in range(1000)]
    df = spark.createDataFrame(rows, "v double").repartition(5)
    import statistics
    want = statistics.median(v for v, in rows if v is not None)
    assert spark.range(1).select(quality.median_of(df, "v").alias("m")).first().m == want
    # approximate quantiles only say where to look; the exact aggregate would hold all values
    plan = plan_of(df.agg(quality.median_of(df, "v").alias("m")))
    assert "percentile(" not in plan and "median(" not in plan
    for values in ([], [None], [3.0], [1.0, 2.0], [5.0, 5.0, 9.0], [1e9, -1e9, 0.0, 4.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None]
        got = spark.range(1).select(quality.median_of(df, "v").alias("m")).first().m
        assert got == (statistics.median(known) if known else None)


@pytest.mark.parametrize("outlier", [1e15, -1e300, 0.0])
def test_no_median_task_holds_many_values(spark, outlier):
    """Ranges are as deep as planned wherever the values lie; only one of them is put in order."""
    from corpuscope.operators import quality
    import statistics
    values = [(i * i % 99_991) / 7 for i in range(100_000)] + [outlier]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    assert spark.range(1).select(quality.median_of(df, "v").alias("m")).first().m == statistics.median(values)
    depth = {r.b: r.n for r in quality._ranges(df, "v").groupBy("b").agg(F.sum("n").alias("n")).collect()}
    assert len(depth) > 10 and max(depth.values()) <= 0.3 * len(values)
    middle = quality._ranges(df, "v").filter(F.col("v") == statistics.median(values)).first().b
    assert depth[middle] <= 0.02 * len(values)


def test_lines_are_scored_within_the_row(spark, tmp_path):
    """No exchange between the scan and a README's share, no join, and nothing broadcast."""
    from corpuscope import schemas
    from corpuscope.operators import language as lg
    files = _table(spark, tmp_path, [("a/b", "README.md", False, "text")], schemas.FILES)
    profile = spark.createDataFrame([("abc", 1, 2)], "trigram string, lp_de long, lp_en long")
    for scored in (lg.english_share(files, profile, ["de", "en"]), lg.line_language(files, profile, ["de", "en"])):
        plan = plan_of(scored)
        for absent in ("Exchange", "Join", "Broadcast", "regexp_extract_all"):
            assert absent not in plan
        assert plan.count("ArrowEvalPython") == 1
    assert "Generate" not in plan_of(lg.english_share(files, profile, ["de", "en"]))
