"""Phase-1 gates and the 0-30 quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import taxonomy as tx


def _num(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _points(value: Column, *steps: tuple[float, int]) -> Column:
    """Sum of the points of every lower bound reached.

    Tiers such as 2 points from 1000 and 1 from 500 are written as one point at each bound,
    which keeps the score flat arithmetic.
    """
    return sum((_int(value >= bound) * points for bound, points in steps), F.lit(0))


def _int(condition: Column) -> Column:
    return condition.cast("int")


def basic_condition(df: DataFrame) -> Column:
    names = [c for c in ("stars", "stargazers_count") if c in df.columns]
    stars = F.coalesce(*[F.col(c) for c in names], F.lit(0))
    condition = (stars >= tx.MIN_STARS) & F.coalesce(F.length("description") > 0, F.lit(False))
    for flag in ("archived", "fork"):
        if flag in df.columns:
            condition &= ~_flag(flag)
    return condition


def hit_condition() -> Column:
    """The part of the basic filter that a raw search hit already decides."""
    return (_num("stargazers_count") >= tx.MIN_STARS) & ~_flag("archived") & ~_flag("fork")


def content_condition() -> Column:
    ai = _num("ai_keyword_count") + _num("ai_dependency_count")
    testing = (_num("test_keyword_count") + _flag("has_test_directory").cast("long")
               + _flag("has_ci_config").cast("long"))
    return (
        (_num("readme_length") >= tx.MIN_README_LENGTH) & (ai >= 1)
        & ((_num("intersection_phrase_count") > 0) | ((ai >= 2) & (testing >= 1)))
    )


def activity_condition() -> Column:
    recent = F.coalesce(F.col("days_since_last_push") <= tx.MAX_DAYS_SINCE_PUSH, F.lit(False))
    return recent & (_num("commit_count") >= 1) & (_num("contributor_count") >= 1)


def basic_filter(df: DataFrame) -> DataFrame:
    """Enough stars, a description, neither archived nor a fork."""
    return df.filter(basic_condition(df))


simple_filter = basic_filter


def content_filter(df: DataFrame) -> DataFrame:
    """A README, and either an explicit phrase or both AI and testing signals."""
    return df.filter(content_condition())


def activity_filter(df: DataFrame) -> DataFrame:
    """Pushed within two years, with commits and contributors."""
    return df.filter(activity_condition())


def score_parts() -> dict[str, Column]:
    """The five sub-scores as whole numbers."""
    push_age = F.coalesce(F.col("days_since_last_push"), F.lit(9999))
    return {
        "popularity": _points(_num("stars"), (100, 1), (500, 1), (1000, 1), (5000, 1), (10000, 1)),
        "activity": _int(push_age <= 30) + _int(push_age <= 90) + _int(push_age <= 365)
        + _points(_num("commits_per_month"), (5, 1), (10, 1)),
        "community": _points(_num("contributor_count"), (10, 1), (50, 1))
        + _int(_flag("has_discussions")) + _int(_num("open_issues") > 0)
        + _int(_flag("has_topics")),
        "documentation": _points(_num("readme_length"), (500, 1), (1000, 1))
        + _int(_flag("has_contributing")) + _int(_flag("has_license"))
        + _int(_flag("has_code_of_conduct")),
        "signals": _points(_num("intersection_phrase_count"), (1, 2), (3, 2))
        + _points(_num("ai_keyword_count"), (5, 1), (10, 1))
        + _points(_num("test_keyword_count"), (5, 1), (10, 1))
        + _int(_num("ai_dependency_count") > 0) + _int(_flag("has_test_directory")),
    }


def score_expression() -> Column:
    total = sum(score_parts().values(), F.lit(0)).cast("double")
    return F.least(total, F.lit(tx.MAX_QUALITY_SCORE))


def score_components(df: DataFrame) -> DataFrame:
    return df.withColumns({name: part.cast("double") for name, part in score_parts().items()})


def quality_score(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_score", score_expression())


def high_precision_filter(df: DataFrame) -> DataFrame:
    """Adds ``quality_score`` and ``passes``; drops no row, so the caller filters.

    The cheap stages come first, and a row that fails one scores 0.0 and is not rated. Apply
    ``dedup_best`` before filtering on ``passes``; see ``plans.mine`` for the reason.
    """
    stages = basic_condition(df) & content_condition() & activity_condition()
    scored = df.withColumn("quality_score", F.when(stages, score_expression()).otherwise(0.0))
    return scored.withColumn("passes", F.col("quality_score") >= tx.MIN_QUALITY_SCORE)
