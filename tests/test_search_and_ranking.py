"""Shard plan and search, ranking under skew, selection, moving average."""

from collections import defaultdict

import pytest
from pyspark.sql import Window as W, functions as F

from corpuscope import taxonomy as tx
from corpuscope.operators import ranking, shards


@pytest.fixture(scope="module")
def plan(spark):
    return shards.shard_plan(spark).cache()


def test_plan_size_and_order(spark, plan):
    rows = plan.orderBy("query_id").collect()
    assert len(rows) == 4814 == shards.plan_size()
    assert [r.query_id for r in rows] == list(range(4814))
    assert len({r.query for r in rows}) == 4814
    assert all("stars:" in r.query for r in rows)
    assert rows[0].query == '"Claude" "Unit Testing" stars:50..100'
    assert rows[5].query == '"Claude" "Unit Testing" stars:>=5000'
    assert rows[-1].query == '"o1-mini" created:2026-01-01..2026-06-30 stars:>=50'


def test_query_stats(plan):
    got = shards.query_stats(plan).first()
    assert (got.n_queries, got.with_language, got.with_period) == (4814, 35 * 5 * 6, 130)
    # ranges: the five closed star ranges of each pair and language, all phrase and period queries
    assert got.with_range == 35 * 17 * 5 + 35 * 5 * 5 + 64 + 130


def test_simple_plan(spark):
    rows = shards.simple_plan(spark).collect()
    assert len(rows) == 35 and rows[0].query == '"Claude" stars:>=50'


def test_repeated_terms_leave_one_query(spark):
    tax = tx.Taxonomy(genai_keywords=("A", "A"), testing_keywords=("t",), phrases=(), languages=())
    got = shards.shard_plan(spark, tax)
    assert got.count() == 6 + 13
    assert [r.query_id for r in got.orderBy("query_id").collect()] == list(range(19))


REPOS = [
    ("x/claude", "Claude with pytest", ["ml"], "Python", 100, "2024-07-01 10:00:00"),
    ("x/low", "Claude", [], "Python", 49, "2024-07-01 00:00:00"),
    ("x/phrase", "neural test tool", [], "Rust", 700, "2024-12-31 23:59:59"),
    ("x/big", "OpenAI", ["jest"], "Go", 10**6, "2025-01-01 00:00:00"),
    ("x/gpt", None, ["GPT-4"], "Java", 5000, None),
]


def test_search_equals_every_predicate(spark, plan):
    repos = spark.createDataFrame(
        REPOS, "full_name string, description string, topics array<string>, language string, stars bigint, c string"
    ).withColumn("created_at", F.to_timestamp("c")).drop("c")
    got = {(r.query_id, r.full_name) for r in shards.shard_search(repos, plan).collect()}
    want = set()
    for q in plan.collect():
        for name, desc, topics, lang, stars, created in REPOS:
            text = " ".join([name, desc or "", *topics]).lower()
            ok = q.term.lower() in text
            if q.strategy == "intersection":
                ok &= q.other.lower() in text
            if q.strategy == "language":
                ok &= lang == q.other
            if q.strategy == "period":
                ok &= stars >= 50 and created is not None and q.created_lo <= created[:10] <= q.created_hi
            else:
                ok &= q.star_lo <= stars and (q.star_hi is None or stars <= q.star_hi)
            if ok:
                want.add((q.query_id, name))
    assert got == want
    # 5000 stars lie in two adjacent ranges
    assert sum(1 for _, n in got if n == "x/gpt") == 2


def test_one_predicate(spark):
    repos = spark.createDataFrame(
        REPOS, "full_name string, description string, topics array<string>, language string, stars bigint, c string"
    ).withColumn("created_at", F.to_timestamp("c"))
    got = shards.shard_predicate(repos, ["claude"], 50, 100, "Python", ("2024-07-01", "2024-12-31"))
    assert [r.full_name for r in got.collect()] == ["x/claude"]


def test_acceptance_counts_each_repository_once(spark):
    hits = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "b"), (2, "c")], "query_id bigint, full_name string")
    ok = spark.createDataFrame([("a",), ("c",), ("z",)], "full_name string")
    got = {r.query_id: (r.found, r.accepted) for r in shards.acceptance_stats(hits, ok).collect()}
    assert got == {0: (2, 1), 1: (1, 0), 2: (2, 1), -1: (5, 2)}


def test_coverage_lists_queries_without_hits(spark):
    plan = spark.createDataFrame([(0, "p"), (1, "q")], "query_id bigint, query string")
    hits = spark.range(1001).selectExpr("0 as query_id")
    got = {r.query_id: (r.n_hits, r.truncated) for r in shards.shard_coverage(hits, plan).collect()}
    assert got == {0: (1001, True), 1: (0, False)}


# -- ranking -----------------------------------------------------------------------------

def skewed(spark):
    """A third of the rows in one group, many ties."""
    return spark.range(30000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('g', id % 500) end as g",
        "id", "cast(hash(id) % 50 as bigint) as v").repartition(6)


def test_salted_ranking_equals_one_window(spark):
    df, order = skewed(spark), [F.col("v").desc(), F.col("id")]
    plain = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).filter("rank <= 40")
    salted = ranking.top_k_per_group(df, ["g"], order, 40, spread=["id"])
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_search_topk_takes_as_many_as_asked(spark):
    hits = spark.range(2500).selectExpr("0 as query_id", "cast(id as string) as full_name", "id as stars", "id as forks")
    assert shards.search_topk(hits, max_results=5000).count() == 2500
    top = shards.search_topk(hits, max_results=1500)
    assert top.count() == 1500 and top.agg(F.min("stars")).first()[0] == 1000
    assert [r.forks for r in shards.search_topk(hits, 2, "forks", False).orderBy("rank").collect()] == [0, 1]


def test_dedup_best(spark):
    df = spark.createDataFrame([
        ("a", "u1", 5, 10.0), ("a", "u2", 9, 10.0), ("a", "u3", 99, None), ("b", "u4", 1, None), ("b", "u5", None, None)],
        "full_name string, html_url string, stars bigint, quality_score double")
    assert {r.full_name: r.html_url for r in ranking.dedup_best(df).collect()} == {"a": "u2", "b": "u4"}


def test_sort_output_with_fewer_columns(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 7)], "full_name string, stars bigint")
    assert [r.full_name for r in ranking.sort_output(df).collect()] == ["d", "a", "b", "c"]


def test_top_languages(spark):
    sizes = {"Python": 10000, "JavaScript": 5000, "TypeScript": 3000, "HTML": 1000, "CSS": 500}
    df = spark.createDataFrame([("a/b", k, v) for k, v in sizes.items()], "full_name string, language string, bytes bigint")
    assert ranking.top_languages(df).first().language_distribution == ["Python", "JavaScript", "TypeScript"]


def test_random_selection_is_exact_and_stable(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as full_name")
    a = [r.full_name for r in ranking.select_random(df, 10).collect()]
    b = [r.full_name for r in ranking.select_random(df.repartition(13), 10).collect()]
    c = [r.full_name for r in ranking.select_random(df, 10, seed=7).collect()]
    assert a == b and len(set(a)) == 10 and a != c
    assert ranking.select_random(df, 5000).count() == 1000


def test_select_top_falls_back_to_stars(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "full_name string, stars bigint")
    assert [r.full_name for r in ranking.select_top(df, 2).collect()] == ["b", "c"]


@pytest.mark.parametrize("block", [1, 3, 10, 40])
@pytest.mark.parametrize("window", [1, 4, 10])
def test_moving_average_with_gaps_and_small_blocks(spark, block, window):
    log = spark.range(120).filter("id % 7 < 4 and (id < 40 or id > 77)").selectExpr(
        "0 as run_id", "id as query_no", "cast(id * id % 17 as double) as seconds", "120 as total")
    rows = sorted((r.query_no, r.seconds) for r in log.collect())
    got = {r.query_no: r.avg_seconds for r in ranking.moving_avg_eta(log, window, block).collect()}
    assert len(got) == len(rows)
    for i, (no, _) in enumerate(rows):
        recent = [s for _, s in rows[max(0, i - window + 1):i + 1]]
        assert got[no] == pytest.approx(sum(recent) / len(recent))


@pytest.mark.parametrize("block", [10, 13, 10_000])
def test_moving_average_equals_one_window(spark, block):
    log = spark.range(100).selectExpr("id % 2 as run_id", "id div 2 as query_no", "cast(id * id % 17 as double) as seconds", "50 as total")
    rows = defaultdict(dict)
    for r in log.collect():
        rows[r.run_id][r.query_no] = r.seconds
    got = ranking.moving_avg_eta(log, block=block).collect()
    assert len(got) == 100
    for r in got:
        recent = [rows[r.run_id][q] for q in range(max(0, r.query_no - 9), r.query_no + 1)]
        assert r.avg_seconds == pytest.approx(sum(recent) / len(recent))
        assert r.eta_seconds == pytest.approx(r.avg_seconds * (49 - r.query_no))


@pytest.mark.parametrize("block, window", [(3, 10), (4, 2), (1, 4), (7, 1), (100, 10)])
def test_moving_average_of_ties_gaps_and_nulls(spark, block, window):
    """Repeated numbers go by their seconds; missing seconds take a place but do not count."""
    rows = [(r, q, s, 60) for r in (1, None) for q, s in (
        [(i, float(i * 7 % 5)) for i in range(0, 40, 3)] + [(9, 100.0), (9, 50.0), (9, 50.0), (10, None), (20, None), (None, 3.0)])]
    log = spark.createDataFrame(rows, "run_id int, query_no long, seconds double, total int")
    got = sorted(((r.run_id is None, r.query_no is not None, r.query_no or 0, r.seconds is not None, r.seconds or 0), r.avg_seconds)
                 for r in ranking.moving_avg_eta(log, window, block).collect())
    assert len(got) == len(rows)
    for one in (False, True):
        own = [g for g in got if g[0][0] is one]
        for i, (key, avg) in enumerate(own):
            recent = [k[4] for k, _ in own[max(0, i - window + 1):i + 1] if k[3]]
            assert avg == (pytest.approx(sum(recent) / len(recent)) if recent else None), key


def test_moving_average_shuffles_the_log_once(spark):
    log = spark.range(1000).selectExpr("0 as run_id", "id as query_no", "1.0D as seconds", "1000 as total")
    plan = ranking.moving_avg_eta(log, block=100)._jdf.queryExecution().executedPlan().toString()
    # the others carry the last rows of each block, cut before they are shuffled
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning(run_id") <= 3


@pytest.mark.parametrize("seconds, no, text", [
    (59.9, 1, "59s"), (61.0, 1, "1m 1s"), (3600.0, 1, "1h 0m"), (7325.0, 1, "2h 2m"), (5.0, 0, "calculating...")])
def test_eta_text(spark, seconds, no, text):
    df = spark.createDataFrame([(seconds, no)], "s double, n bigint")
    assert df.select(ranking.format_eta(F.col("s"), F.col("n")).alias("t")).first().t == text
