"""Every registered query against its SQL, on the smallest tables, and its plan."""

import pytest

import __spark_entry__
from checks import compare
from checks.registry import ORACLES as SQL, QUERIES, oracle_text
from .conftest import SMALL

ORACLES = {key: oracle_text(sql) for key, sql in SQL.items()}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


#: README lines are summed in Arrow batches; nothing else runs Python in its rows.
LANGUAGE = {"line_language", "english_share", "readme_language", "readme_lang", "join_language", "language_gate",
            "validate", "validation_funnel", "validate_resumed"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "NestedLoopJoin", "MapInPandas", *([] if key in LANGUAGE else ["EvalPython"])):
        assert banned not in plan
    assert compare.compare(spark, SMALL, key, lambda *_: df, ORACLES.get(key), duck) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "quality_score" in df.columns
