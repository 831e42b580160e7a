"""Detection over repositories: the cap, catalogs, READMEs, artifacts and summaries."""

import datetime as dt

import pytest
from pyspark.sql import Window as W, functions as F

from corpuscope import plans, schemas
from corpuscope.operators import files as fo, mentions as mn

DAY = dt.datetime(2024, 1, 1)


def commits(spark, rows):
    return spark.createDataFrame(
        [(r, c, None if d is None else DAY + dt.timedelta(days=d), "dev", m) for r, c, d, m in rows], schemas.COMMITS)


def files(spark, rows):
    return spark.createDataFrame([(r, p, False, c) for r, p, c in rows], schemas.FILES)


def repos(spark, rows):
    return spark.createDataFrame(
        rows, "full_name string, description string, topics array<string>, has_ci_config boolean, has_test_directory boolean")


@pytest.mark.parametrize("cap", [1, 7, 50, 400, 10_000])
def test_cap_equals_one_window(spark, cap):
    """One repository owns half of all commits, most of them on one day, some without a date."""
    df = spark.range(4000).selectExpr(
        "case when id % 2 = 0 then 'hot' else concat('r', id % 40) end as full_name",
        "md5(cast(id as string)) as commit_id",
        "case when id % 97 = 0 then null when id % 10 < 8 then timestamp'2024-05-05 12:00:00' "
        "else timestampadd(DAY, cast(id % 300 as int), timestamp'2024-01-01 00:00:00') end as committed_at",
        "'d' as author_id", "'m' as message")
    order = W.partitionBy("full_name").orderBy(F.col("committed_at").asc_nulls_first(), "commit_id")
    want = {r.commit_id for r in df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap).collect()}
    assert {r.commit_id for r in mn.cap_commits(df, cap).collect()} == want
    cut = {r.full_name: r for r in mn.commit_cutoffs(df, cap).collect()}
    assert cut["hot"].n_commits == 2000 and cut["hot"].cap_hit is (cap < 2000)


def test_readme_order_of_preference(spark):
    f = files(spark, [("a", "readme.md", "Claude"), ("a", "README.rst", "Gemini"), ("b", "README.txt", "Mistral"),
                      ("a", "docs/README.md", "Kimi"), ("b", "x.py", "Claude")])
    assert {(r.full_name, r.path) for r in fo.pick_readme(f).collect()} == {("a", "README.rst"), ("b", "README.txt")}
    assert {(r.repo_id, r.keyword, r.provenance) for r in mn.readme_mentions(f).collect()} == {
        ("a", "Gemini", "README.rst"), ("b", "Mistral", "README.txt")}


def test_config_artifacts_once_per_path(spark):
    f = files(spark, [("a", ".cursor/rules/x.mdc", ""), ("a", ".cursor/rules/y.mdc", ""), ("a", "sub/CLAUDE.md", ""),
                      ("a", "AGENTS.md", ""), ("b", ".cursorrules", "")])
    got = {(r.repo_id, r.keyword, r.provenance, r.context_snippet) for r in mn.config_artifacts(f).collect()}
    assert got == {("a", "Cursor", ".cursor/rules", "present: .cursor/rules"),
                   ("a", "generic-agent", "AGENTS.md", "present: AGENTS.md"),
                   ("b", "Cursor", ".cursorrules", "present: .cursorrules")}


def test_presence_flags(spark):
    f = spark.createDataFrame([
        ("a", "tests/x.py", False, None), ("b", "tests", False, None), ("c", "test", True, None),
        ("d", ".github/workflows/ci.yml", False, None), ("e", "latests/x", False, None), ("e", "CONTRIBUTING.md", False, None),
        ("f", "circle.yml.bak", False, None)], schemas.FILES)
    got = {r.full_name: r.asDict() for r in fo.files_profile(f).collect()}
    assert {k for k, r in got.items() if r["has_test_directory"]} == {"a", "c"}
    assert {k for k, r in got.items() if r["has_ci_config"]} == {"d"}
    assert {k for k, r in got.items() if r["has_contributing"]} == {"e"}


def detect(spark, cap=100, **kw):
    r = repos(spark, [("x/a", "d", [], True, False), ("x/b", "d", [], None, None), ("x/awesome-c", "d", [], True, True),
                      ("x/quiet", None, None, False, False)])
    c = commits(spark, [
        ("x/a", "c1", 0, "Add test with Claude"), ("x/a", "c2", 1, "x\n\nCo-authored-by: Copilot <a@b.c>"),
        ("x/a", "c3", 2, "Gemini"), ("x/b", "c4", 3, "x\nCo-authored-by: Cursor"), ("x/awesome-c", "c5", 4, "Claude"),
        ("x/unknown", "c6", 5, "Claude")])
    f = files(spark, [("x/b", "AGENTS.md", ""), ("x/a", "README.md", "uses OpenAI")])
    return plans.detect(r, c, f, cap=cap, **kw)


def test_detection_and_summary(spark):
    found = detect(spark)
    got = {(m.repo_id, m.source_artifact, m.keyword, m.testing_relevant) for m in found.mentions.collect()}
    assert got == {
        ("x/a", "commit_message", "Claude", True), ("x/a", "commit_message", "Copilot", False),
        ("x/a", "commit_trailer", "Copilot", True), ("x/a", "commit_message", "Gemini", False),
        ("x/a", "readme", "OpenAI", False), ("x/b", "commit_message", "Cursor", False),
        ("x/b", "commit_trailer", "Cursor", False), ("x/b", "config_artifact", "generic-agent", False)}
    rows = {r.repo_id: r for r in found.summary.collect()}
    assert set(rows) == {"x/a", "x/b", "x/quiet"}
    a, quiet = rows["x/a"], rows["x/quiet"]
    assert (a.n_mentions, a.n_testing_relevant, a.distinct_tools, a.n_commits_scanned) == (5, 2, 4, 3)
    assert (a.first_mention_date, a.first_testing_mention_date) == (DAY, DAY)
    assert (quiet.n_mentions, quiet.has_mention, quiet.first_mention_date, quiet.distinct_tools) == (0, False, None, 0)
    assert rows["x/b"].has_mention and not rows["x/b"].has_testing_mention
    totals = found.totals.first()
    assert (totals.n_repos, totals.n_testing) == (3, 1) and totals.pct_testing == pytest.approx(100 / 3)
    assert [r.repo_id for r in found.skipped.collect()] == ["x/awesome-c"]


def test_cap_applies_to_mentions(spark):
    found = detect(spark, cap=1)
    kept = {m.provenance for m in found.mentions.collect() if m.source_artifact.startswith("commit")}
    assert kept == {"c1", "c4"}
    row = found.summary.filter("repo_id = 'x/a'").first()
    assert (row.n_commits_scanned, row.commit_cap_hit) == (1, True)


def test_catalogs_on_request_and_resume(spark):
    assert "x/awesome-c" in {m.repo_id for m in detect(spark, include_catalog=True).mentions.collect()}
    done = spark.createDataFrame([("x/a",)], "full_name string")
    assert {r.repo_id for r in detect(spark, done=done).summary.collect()} == {"x/b", "x/quiet"}
