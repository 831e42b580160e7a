"""Phase-2 gates, the excluded rows with their reasons, and the funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import taxonomy as tx
from ..functions import text as fx
from .quality import median_of

STAGES = (
    "Phase 1 candidates",
    "Stage 1 - License gate",
    "Stage 2 - Testing-infra gate",
    "Stage 3 - Tutorial/template exclusion",
    "Stage B - Language gate (>=80% English)",
)


def license_ok(allowed: Sequence[str] = tx.ACCEPTED_LICENSES) -> Column:
    return F.coalesce(F.col("license").isin(*allowed), F.lit(False))


def infra_ok() -> Column:
    return (F.coalesce(F.col("has_ci_config"), F.lit(False))
            | F.coalesce(F.col("has_test_directory"), F.lit(False)))


def _tutorial() -> Column:
    text = F.concat_ws(" ", F.col("full_name"), F.coalesce(F.col("description"), F.lit("")))
    return fx.tutorial_hit(text, "topics")


def license_gate(df: DataFrame, allowed: Sequence[str] = tx.ACCEPTED_LICENSES) -> DataFrame:
    """Rows with an accepted license; a missing license is not accepted."""
    return df.filter(license_ok(allowed))


def infra_gate(df: DataFrame) -> DataFrame:
    """Rows with a CI configuration or a test directory; unknown counts as no."""
    return df.filter(infra_ok())


def tutorial_reason(df: DataFrame) -> DataFrame:
    """Adds ``tutorial_reason``, NULL where no rule fires."""
    return _once(df, _tutorial()).withColumn("tutorial_reason", _reason()).drop("_hit")


def _once(df: DataFrame, hit: Column) -> DataFrame:
    """Adds ``_hit``. The outer explode keeps Spark from copying the rules into filters on it."""
    return df.withColumn("_hit", F.explode_outer(F.array(hit)))


def _reason() -> Column:
    hit = F.col("_hit")
    return F.concat(F.lit("tutorial: "), hit["keyword"], F.lit(" (matched '"), hit["token"], F.lit("')"))


def tutorial_gate(df: DataFrame) -> DataFrame:
    """Rows that no tutorial rule hits."""
    return tutorial_reason(df).filter(F.col("tutorial_reason").isNull()).drop("tutorial_reason")


def stage_a(df: DataFrame) -> DataFrame:
    """Adds ``exclusion_stage``: the first gate that stops the row, NULL for survivors.

    One narrow pass. The token rules are the expensive part and only run on rows that both
    cheap gates let through.
    """
    tutorial = F.when(license_ok() & infra_ok(), _tutorial())
    hit = F.col("_hit")
    stage = (
        F.when(~license_ok(), "license: not an accepted OSS license")
        .when(~infra_ok(), "testing-infra: no CI/CD config and no test directory")
        .when(hit.isNotNull(), _reason())
    )
    return _once(df, tutorial).withColumn("exclusion_stage", stage).drop("_hit")


def survivors(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("exclusion_stage").isNull()).drop("exclusion_stage")


def excluded(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("exclusion_stage").isNotNull())


def union_excluded(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Rows dropped by separate gates, each with its reason."""
    out = None
    for rows, reason in parts:
        rows = rows.withColumn("exclusion_stage", F.lit(reason))
        out = rows if out is None else out.unionByName(rows)
    return out


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others; NULL counts as not met."""
    met = F.coalesce(condition, F.lit(False))
    return df.filter(met), df.filter(~met)


def join_language(df: DataFrame, languages: DataFrame) -> DataFrame:
    """Adds the README language; a repository without a result keeps NULLs."""
    return df.join(languages, "full_name", "left")


def language_ok(threshold: float = tx.ENGLISH_THRESHOLD) -> Column:
    share = F.coalesce(F.col("readme_lang_conf"), F.lit(1.0))
    return F.col("readme_lang").isNull() | (share >= threshold)


def language_gate(df: DataFrame, threshold: float = tx.ENGLISH_THRESHOLD) -> DataFrame:
    """Rows whose README is English enough; undetectable and missing READMEs stay."""
    return df.filter(language_ok(threshold))


def funnel(staged: DataFrame) -> DataFrame:
    """Rows remaining after each stage and removed by it, from one aggregation.

    ``staged`` is the output of :func:`stage_a`; with README language columns the language
    gate is the last line.
    """
    reason = fx.exclusion_reason("exclusion_stage")
    past_license = F.coalesce(reason != "license", F.lit(True))
    past_infra = past_license & F.coalesce(reason != "testing-infra", F.lit(True))
    past_tutorial = F.col("exclusion_stage").isNull()
    passed = [F.lit(True), past_license, past_infra, past_tutorial]
    if "readme_lang" in staged.columns:
        passed.append(past_tutorial & language_ok())
    counts = staged.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(passed)])
    rows = [
        F.struct(
            F.lit(i + 1).cast("long").alias("step"), F.lit(STAGES[i]).alias("stage"),
            F.col(f"c{i}").alias("remaining"),
            (F.col(f"c{max(i - 1, 0)}") - F.col(f"c{i}")).alias("removed"),
        ) for i in range(len(passed))
    ]
    return counts.select(F.inline(F.array(*rows)))


def exclusion_breakdown(excluded_rows: DataFrame) -> DataFrame:
    """Excluded rows per reason, most frequent first."""
    return (
        excluded_rows.groupBy(fx.exclusion_reason("exclusion_stage").alias("reason"))
        .agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("reason"))
    )


def corpus_profile(df: DataFrame) -> DataFrame:
    """Size, CI share, median stars and mean score of the validated corpus."""
    ci = F.coalesce(F.col("has_ci_config"), F.lit(False)).cast("long")
    return df.agg(
        F.count("*").alias("n_repos"), F.sum(ci).alias("n_ci"),
        (F.avg(ci) * 100).alias("pct_ci"), median_of(df, "stars").alias("median_stars"),
        F.avg("quality_score").alias("mean_score"),
    )
