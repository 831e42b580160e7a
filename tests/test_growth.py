"""What must not grow faster than the input: stored texts, memory of a batch, work that is done twice."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import io
from checks.views import VIEWS, Views, parts_of
from corpuscope import plans, taxonomy as tx
from corpuscope.functions import text as fx
from corpuscope.operators import language as lg, mentions as mn
from corpuscope.plans import detection, mining, validation
from corpuscope.sources.manifest import Manifest


def test_files_are_read_where_the_texts_lie(spark, tmp_path):
    tables = {
        "documents": spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(16),
        "orders": spark.createDataFrame([(i, i % 7) for i in range(30)], "o_orderkey long, o_custkey long"),
        "lineitem": spark.createDataFrame([(i % 30, i, i % 11) for i in range(90)], "l_orderkey long, l_partkey long, l_suppkey long")}
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    files = Views(spark, str(tmp_path)).files
    assert any("documents.parquet" in f for f in files.inputFiles())
    whole = spark.sql(VIEWS["files"], **{p: tables[p] for p in parts_of(VIEWS["files"])})
    assert sorted(map(str, files.collect())) == sorted(map(str, whole.collect()))


def test_sums_hold_no_copy_of_a_batch(monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.integers(-9, 0, (lg.CELLS, 3))
    texts = [None, "", "  ", *("".join(rng.choice(list("abz~ "), n)) for n in rng.integers(0, 60, 50))]
    number = lambda t: (ord(t[0]) & 31) << 10 | (ord(t[1]) & 31) << 5 | ord(t[2]) & 31
    numbers = [[number(t[i:i + 3]) for i in range(len(t or "") - 2)] for t in texts]
    counted = np.bincount(sum(numbers, []), minlength=lg.CELLS)
    for stretch in (1, 7, 1 << 20):
        monkeypatch.setattr(lg, "STRETCH", stretch)
        assert lg.sums(pa.array(texts, pa.string()), dense).tolist() == [dense[n].sum(0).tolist() for n in numbers]
        assert (lg.count_trigrams(pa.array([t for t in texts if t and len(t) > 1], pa.string())) == counted).all()
    large = pa.array(["abc de " * 1000] * 2000)
    tracemalloc.start()
    lg.sums(large, dense)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_profile_is_counted_without_a_row_a_trigram(spark):
    docs = spark.createDataFrame([("en", "Ab, ab é"), ("de", "ab"), ("en", None), ("xx", "ab")], "lang string, text string")
    profile = lg.train_profile(docs, ("de", "en"))
    assert "Generate" not in profile._jdf.queryExecution().executedPlan().toString()
    assert {r["trigram"] for r in profile.collect()} == {" ab", "ab ", "b a", "b ~", " ~ "}


def test_snippets_are_lowered_once(spark, tmp_path):
    spark.createDataFrame([("a/b", None, "1", "x")], "full_name string, committed_at timestamp, commit_id string, message string").write.parquet(str(tmp_path / "c"))
    plan = mn.commit_mentions(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(context_snippet") == 1


def test_a_run_searches_the_texts_of_its_own_repositories(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(detection, "detect_repo_mentions", lambda todo, commits, files, *_: seen.append(
        [sorted(str(r["full_name"]) for r in t.collect()) for t in (commits, files)]) or spark.createDataFrame([], mn.schemas.MENTIONS))
    repos = spark.createDataFrame([(n, "", [], True, True) for n in ("a/a", "b/b")],
                                  "full_name string, description string, topics array<string>, has_ci_config boolean, has_test_directory boolean")
    texts = spark.createDataFrame([("a/a",), ("b/b",), (None,)], "full_name string")
    plans.detect(repos, texts, texts, done=repos.select("full_name").limit(1))
    plans.detect(repos, texts, texts)
    assert seen[0] == [["b/b"], ["b/b"]]


def test_a_known_profile_is_not_trained_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(validation, "train_profile", None)
    docs = spark.createDataFrame([("en", "some words")], "lang string, text string")
    mined = spark.createDataFrame([("a/a", "", [], "MIT License", True, True)],
                                  "full_name string, description string, topics array<string>, license string, has_ci_config boolean, has_test_directory boolean")
    files = spark.createDataFrame([("a/a", "README.md", False, "some words")], "full_name string, path string, is_dir boolean, content string")
    found = plans.validate(mined, files, docs, ("en",), profile=lg.train_profile(docs, ("en",)))
    assert found.verdicts.count() == 1


def test_a_batch_of_arrivals_has_a_file_a_core(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "shared_folder", lambda *_: str(tmp_path / "landing"))
    io._landing(SimpleNamespace(spark=spark), spark.range(1000), "landing")
    assert len(list((tmp_path / "landing").glob("*.parquet"))) == 4 * spark.sparkContext.defaultParallelism


def test_a_mining_run_that_goes_on_adds_up_new_repositories_only(spark, tmp_path, monkeypatch):
    seen = []
    names = spark.createDataFrame([("a/a",), ("b/b",)], "full_name string")
    done = names.limit(1).withColumn("first_query_id", F.lit(1).cast("long"))
    manifest = Manifest(spark, str(tmp_path))
    entries = {part: manifest.fresh(part) for part in ("found", "results", "queries")}
    done.write.parquet(f"{manifest.root}/{entries['found']}")
    done.select("full_name").write.parquet(f"{manifest.root}/{entries['results']}")
    spark.createDataFrame([], mining.QUERIES).write.parquet(f"{manifest.root}/{entries['queries']}")
    manifest.commit(entries)
    monkeypatch.setattr(mining, "found_by_search", lambda *_, **__: names.withColumn("first_query_id", F.lit(2).cast("long")))
    monkeypatch.setattr(mining, "sort_output", lambda df: df)
    monkeypatch.setattr(mining, "mine", lambda hits, *facts: seen.extend(
        [r["full_name"] for r in t.collect()] for t in facts[:5]) or hits)
    plans.mine_run(names, names, names, names, names, names, names, "2026-01-01", str(tmp_path))
    assert seen == [["b/b"]] * 5


def test_folding_is_that_of_the_columns(spark):
    texts = ["", None, "  ", "Ab, ab é", "İstanbul K\u212a ΣΑΣ", "ǅ 你好 𝒜𐐀 \ufeffx", "a" * 50 + "  -- " * 9, "\n", "ß", "\u0345a1b"]
    texts += ["".join(chr(c) for c in range(lo, lo + 997) if not 0xD800 <= c < 0xE000) for lo in range(1, 0x32400, 997)]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1).select(lg.fold_letters("t")).collect()]
    fold = lg.folding(spark)
    for stretch in (7, 1 << 20):
        fold_small = pytest.MonkeyPatch()
        fold_small.setattr(lg, "STRETCH", stretch)
        got = fold(pa.array(texts)).to_pylist()
        fold_small.undo()
        assert [t if t.strip() else "" for t in got] == [t if t and t.strip() else "" for t in want]


def test_tokens_are_split_once_for_all_rules(spark):
    rows = spark.createDataFrame([("My Demo labs", ["x"]), ("plain", [" Tutorial "]), ("plain", None), (None, None)], "t string, p array<string>")
    hit = rows.select(fx.tutorial_hit("t", "p").alias("h"))
    assert hit._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["h"] and r["h"]["token"] for r in hit.collect()] == ["demo", "tutorial", None, None]


def test_texts_without_code_and_links_are_cleaned_alike(spark):
    texts = ["a `b` c", "```x``` `", "see http://a.b/c `d://e` #f", "a:```b```//c", "``", None, "plain text", "https://x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    plain = F.col("t")
    for pattern in ("(?s)" + tx.CODE_FENCE, tx.INLINE_CODE, "(?U)" + tx.URL, tx.MARKDOWN_MARKS):
        plain = F.regexp_replace(plain, pattern, " ")
    assert df.where(~fx.clean_readme("t").eqNullSafe(plain)).count() == 0
