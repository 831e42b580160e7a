"""Gates and score, by perturbing one good record."""

import json

import pytest
from pyspark.sql import functions as F

from corpuscope import taxonomy as tx
from corpuscope.operators import enrich, gates, quality, repos, validation as va

GOOD = dict(
    full_name="org/helper", description="Checks for a chat assistant", stars=640, readme_length=1200,
    ai_keyword_count=7, test_keyword_count=6, ai_dependency_count=1, intersection_phrase_count=1,
    days_since_last_push=75, commit_count=420, contributor_count=12, open_issues=3,
    commits_per_month=6.5, archived=False, fork=False, has_test_directory=True, has_ci_config=True,
    has_discussions=True, has_topics=True, has_contributing=True, has_license=True,
    has_code_of_conduct=True, license="MIT License", topics=["ai"])
KINDS = {int: "bigint", float: "double", bool: "boolean", str: "string", list: "array<string>"}
SCHEMA = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in GOOD.items())


def frame(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.values()) for c in changes or ({},)], SCHEMA)


def score(spark, **change):
    return gates.quality_score(frame(spark, change)).first().quality_score


def test_worked_score(spark):
    parts = gates.score_components(frame(spark)).first()
    assert [parts[p] for p in ("popularity", "activity", "community", "documentation", "signals")] == [2, 3, 4, 5, 6]
    assert score(spark) == 20.0


@pytest.mark.parametrize("field, values, scores", [
    ("stars", [99, 100, 499, 500, 1000, 5000, 10000, None], [0, 1, 1, 2, 3, 4, 5, 0]),
    ("days_since_last_push", [30, 31, 90, 91, 365, 366, None], [3, 2, 2, 1, 1, 0, 0]),
    ("commits_per_month", [4.9, 5.0, 10.0], [0, 1, 2]), ("contributor_count", [9, 10, 50], [0, 1, 2]),
    ("readme_length", [499, 500, 1000], [0, 1, 2]), ("intersection_phrase_count", [0, 1, 2, 3], [0, 2, 2, 4]),
    ("ai_keyword_count", [4, 5, 10], [0, 1, 2]), ("test_keyword_count", [4, 5, 10], [0, 1, 2]),
    ("ai_dependency_count", [0, 1], [0, 1]), ("open_issues", [0, 1], [0, 1]),
    ("has_license", [False, True, None], [0, 1, 0])])
def test_tiers(spark, field, values, scores):
    rows = gates.quality_score(frame(spark, *[{field: v, "full_name": str(i)} for i, v in enumerate(values)]))
    got = [r.quality_score for r in rows.orderBy("full_name").collect()]
    assert [g - got[0] for g in got] == [s - scores[0] for s in scores]


def test_score_is_capped(spark):
    top = dict(stars=10**6, contributor_count=99, readme_length=9999, intersection_phrase_count=9,
               ai_keyword_count=99, test_keyword_count=99, days_since_last_push=1, commits_per_month=99.0)
    assert score(spark, **top) == 30.0


@pytest.mark.parametrize("change, passes", [
    ({}, True), (dict(stars=49), False), (dict(stars=50), True), (dict(description=""), False),
    (dict(description=None), False), (dict(archived=True), False), (dict(fork=True), False),
    (dict(archived=None), True)])
def test_basic(spark, change, passes):
    assert (gates.basic_filter(frame(spark, change)).count() == 1) is passes


def test_basic_falls_back_to_the_raw_star_count(spark):
    raw = frame(spark).withColumnRenamed("stars", "stargazers_count")
    assert gates.simple_filter(raw).count() == 1


@pytest.mark.parametrize("change, passes", [
    ({}, True), (dict(readme_length=99), False), (dict(ai_keyword_count=0, ai_dependency_count=0), False),
    (dict(ai_keyword_count=1, ai_dependency_count=0, intersection_phrase_count=0), False),
    (dict(ai_keyword_count=1, ai_dependency_count=0), True),
    (dict(intersection_phrase_count=0), True),
    (dict(intersection_phrase_count=0, test_keyword_count=0, has_test_directory=False), True),
    (dict(intersection_phrase_count=0, test_keyword_count=0, has_test_directory=None, has_ci_config=None), False)])
def test_content(spark, change, passes):
    assert (gates.content_filter(frame(spark, change)).count() == 1) is passes


@pytest.mark.parametrize("change, passes", [
    ({}, True), (dict(days_since_last_push=730), True), (dict(days_since_last_push=731), False),
    (dict(days_since_last_push=None), False), (dict(commit_count=0), False), (dict(contributor_count=0), False)])
def test_activity(spark, change, passes):
    assert (gates.activity_filter(frame(spark, change)).count() == 1) is passes


def test_high_precision_keeps_every_row(spark):
    rows = gates.high_precision_filter(frame(spark, {}, dict(stars=1), dict(days_since_last_push=None))).collect()
    assert sorted((r.passes, r.quality_score) for r in rows) == [(False, 0.0), (False, 0.0), (True, 20.0)]


# -- validation ------------------------------------------------------------------------

CASES = {
    "ok": {}, "no-license": dict(license=None), "other": dict(license="Other"),
    "null-infra": dict(has_ci_config=None, has_test_directory=None),
    "ci-only": dict(has_ci_config=True, has_test_directory=None), "x/demo-1": {}, "topic": dict(topics=["demo-app"]),
    "null-all": dict(license=None, has_ci_config=None, topics=None, description=None)}


def staged(spark):
    return va.stage_a(frame(spark, *[{**c, "full_name": n} for n, c in CASES.items()]))


def test_stage_a_reasons(spark):
    got = {r.full_name: r.exclusion_stage for r in staged(spark).collect()}
    assert got == {
        "ok": None, "no-license": "license: not an accepted OSS license",
        "other": "license: not an accepted OSS license",
        "null-infra": "testing-infra: no CI/CD config and no test directory", "ci-only": None,
        "x/demo-1": "tutorial: demo (matched 'demo')", "topic": None,
        "null-all": "license: not an accepted OSS license"}


def test_survivors_and_excluded_make_up_the_input(spark):
    table = staged(spark)
    a, b = va.survivors(table).count(), va.excluded(table).count()
    assert a + b == len(CASES)
    steps = va.funnel(table).orderBy("step").collect()
    assert steps[0].remaining == len(CASES) and steps[-1].remaining == a
    assert sum(s.removed for s in steps) == b


def test_single_gates_agree_with_stage_a(spark):
    table = frame(spark, *[{**c, "full_name": n} for n, c in CASES.items()])
    chained = va.tutorial_gate(va.infra_gate(va.license_gate(table)))
    assert {r.full_name for r in chained.collect()} == {r.full_name for r in va.survivors(staged(spark)).collect()}


@pytest.mark.parametrize("lang, conf, passes", [
    (None, None, True), ("en", 0.8, True), ("non-en", 0.5, False), ("non-en", None, True), (None, 0.1, True)])
def test_language_gate(spark, lang, conf, passes):
    df = spark.createDataFrame([(lang, conf)], "readme_lang string, readme_lang_conf double")
    assert (va.language_gate(df).count() == 1) is passes


def test_split_is_null_safe(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    met, rest = va.split(df, F.col("f"))
    assert (met.count(), rest.count()) == (1, 2)


# -- records and report ----------------------------------------------------------------

def test_defaults_fill_a_bare_record(spark):
    row = repos.with_defaults(spark.createDataFrame([("a/b",)], "full_name string")).first()
    assert (row.stars, row.topics, row.default_branch, row.description, row.pushed_at, row.has_wiki) == (
        0, [], "main", "", None, False)


def test_enrich_without_any_side(spark):
    from corpuscope import schemas
    hit = spark.createDataFrame(
        [("a/b", "u", 5, None, None, 1, 2, False, False, "Go", None)], schemas.SEARCH_HIT)
    sides = [spark.createDataFrame([], s) for s in (
        schemas.DETAILS, schemas.COMMITS, schemas.RELEASES, schemas.LANGUAGES, schemas.FILES)]
    row = enrich.enrich(hit, *sides, "2026-01-01").first()
    assert (row.stars, row.forks, row.commit_count, row.commits_per_month, row.language_distribution) == (5, 0, 0, 0.0, [])
    assert row.days_since_created is None and row.has_ci_config is False


def test_unknown_age_keeps_the_commit_count(spark):
    from corpuscope import schemas
    hit = spark.createDataFrame([("a/b", "u", 5, 0, 0, 1, 2, False, False, "Go", "d")], schemas.SEARCH_HIT)
    commits = spark.createDataFrame([("a/b", str(i), None, "x", "m") for i in range(3)], schemas.COMMITS)
    sides = [spark.createDataFrame([], s) for s in (
        schemas.DETAILS, schemas.RELEASES, schemas.LANGUAGES, schemas.FILES)]
    row = enrich.enrich(hit, sides[0], commits, *sides[1:], "2026-01-01").first()
    assert (row.commit_count, row.commits_per_month, row.contributor_count) == (3, 0.0, 1)


def test_structure_issues(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 2), (None, 3), (None, None), ("b", 5)], "full_name string, stars bigint")
    got = {(r.issue, r.column): r.n for r in quality.structure_issues(df).collect()}
    assert got == {("missing column", "html_url"): 1, ("duplicate rows", "full_name"): 4,
                   ("null values", "full_name"): 2, ("null values", "stars"): 1}


def test_quality_issues_skip_absent_columns(spark):
    df = spark.createDataFrame([(1,), (60,)], "stars bigint")
    assert {r.issue: r.n for r in quality.quality_issues(df).collect()} == {"low stars": 1}


def test_completeness_of_an_empty_table(spark):
    df = spark.createDataFrame([], "stars bigint")
    assert quality.completeness(df).first().percentage is None


def test_report_on_a_table_with_few_columns(spark):
    df = spark.createDataFrame([("a",), ("a",)], "full_name string")
    got = json.loads(quality.report(df).first().report)
    assert got["total_repos"] == 2 and got["quality_issues"] == []
    assert got["enrichment_stats"] == {"total_repos": 2, "enrichment_completeness": {}}
    assert got["structure_issues"] == [
        "Missing required column: html_url", "Missing required column: stars", "Found 2 duplicate repositories"]
    assert quality.quality_issues(df).count() == 0 == quality.completeness(df).count()


def test_report_numbers(spark):
    got = json.loads(quality.report(frame(spark, {}, dict(stars=10, description="")).withColumn(
        "quality_score", F.lit(12.0))).first().report)
    assert got["quality_issues"] == [
        "Found 1 repos with < 50 stars (below threshold)", "Found 1 repos without descriptions"]
    assert got["enrichment_stats"]["quality_scores"] == {"mean": 12.0, "median": 12.0, "min": 12.0, "max": 12.0, "std": 0.0}
    assert got["enrichment_stats"]["enrichment_completeness"]["stars"] == {"count": 2, "percentage": 100.0}


def test_thresholds_are_the_documented_ones():
    assert (tx.MIN_STARS, tx.MIN_README_LENGTH, tx.MAX_DAYS_SINCE_PUSH, tx.MIN_QUALITY_SCORE) == (50, 100, 730, 10)
