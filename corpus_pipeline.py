"""The training-data pipeline over ``documents``: what is kept of them, packed for training.

Language identification drops documents without a recognisable language, quality rules drop
those that fail, near-duplicate removal keeps one document of each group, and packing lays the
rest into windows. Every stage but the last returns the columns it was given. Models are
learned from the stage's own input and the labels; nothing is learned from held-out documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.llm import langid, minhash, packing, queries, rules
from corpuscope.llm.common import Kept, bounded_batches, table
from corpuscope.llm.queries import ORACLES as PIPELINE_ORACLES, QUERIES as PIPELINE_QUERIES

#: A document goes if its words give their best language less than this probability on average.
LEAST_LANGUAGE_SCORE = 0.35


def _beside(docs: DataFrame, **columns) -> DataFrame:
    """The rows as one column ``row``, so that new columns clash with none of theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       *(c.alias(name) for name, c in columns.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no letter or no language that fits its words (null and empty texts too)."""
    bounded_batches(spark)
    found = langid.language(docs["text"], queries.language_model(spark, docs))
    fits = (F.col("found.lang_pred") != langid.UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE_SCORE)
    return _beside(docs, found=found).where(fits).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base tests or a learned rule."""
    bounded_batches(spark)
    learned = queries.rule_list(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, m=rules.measure(docs["text"])).select("row", "m.*").where(rules.verdict(learned)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of copies and near copies."""
    bounded_batches(spark)
    return minhash.drop_near_duplicates(docs, lambda model: queries.shared(spark, model))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents into windows, one row a piece."""
    bounded_batches(spark)
    return packing.pack(docs, *queries.byte_bpe())


STAGES = [("language", language), ("quality rules", quality), ("near duplicates", near_duplicates), ("packing", pack)]

#: Learned models, samples and windows are beyond SQL; ``tests/llm`` hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage."""
    kept = Kept(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = PIPELINE_QUERIES | {"pipeline": run}
if ORACLE_SQL is not None:
    PIPELINE_ORACLES = PIPELINE_ORACLES | {"pipeline": ORACLE_SQL}
