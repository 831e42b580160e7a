"""Written tables: their shuffle files go, the session's setting stays; ids of blocks in four or eight bytes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import collocations
from corpuscope.llm.common import CLEAN_UP, Kept


@pytest.mark.parametrize("before", ["false", "true"])
def test_a_written_table_leaves_the_setting_as_it_was(spark, before):
    was = spark.conf.get(CLEAN_UP, "false")
    try:
        spark.conf.set(CLEAN_UP, before)
        kept = Kept(spark, "written")
        grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
        first, second = kept.write(grouped), kept.write(grouped)  # a plan may be written twice
        assert spark.conf.get(CLEAN_UP) == before
        assert sorted(first.collect()) == sorted(second.collect()) == sorted(grouped.collect())
        with pytest.raises(Exception):
            kept.write(grouped.select(F.raise_error(F.lit("no table"))))
        assert spark.conf.get(CLEAN_UP) == before
        kept.drop(first)
        kept.drop(first)
    finally:
        spark.conf.set(CLEAN_UP, was)


@pytest.mark.parametrize("ids, wide", [([5, -1, -1, 0, 7, -1], False), ([1, (1 << 31) - 1], False), ([1, 1 << 31, -1, 3], True)])
def test_ids_of_a_block_come_back(ids, wide):
    row = collocations._dense(3, np.array(ids, np.int64))
    assert row["block"].tolist() == [3] and row["wide"].tolist() == [wide]
    assert len(row["ids"][0]) % (8 if wide else 4) == 0
    batch = pa.RecordBatch.from_pandas(row[["wide", "ids"]])
    (got,) = collocations._ids_of(batch)
    want = [i for i, before in zip(ids, [-1, *ids]) if i >= 0 or before >= 0]  # one gap between runs
    assert got.dtype == np.int64 and got.tolist() == (want[:-1] if want[-1] == -1 else want)


def test_a_block_without_ids_has_no_row():
    assert len(collocations._dense(0, np.full(4, -1, np.int64))) == 0
    assert len(collocations._dense(0, np.zeros(0, np.int64))) == 0
