"""Quality report on an output table. Each report is one aggregation over one scan.

Medians are exact and come from a second scan of their column: see :func:`median_of`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import taxonomy as tx


#: Shares of the values below which the ranges end that the middle is looked for in: ever
#: narrower towards one half, so that the range around it holds about 1/500 of the values.
MEDIAN_CUTS = tuple(sorted({0.5 + side / 2 ** k for k in range(2, 11) for side in (-1, 1)} | {0.5}))


def _ranges(df: DataFrame, column: str) -> DataFrame:
    """The distinct values ``v`` of a column with their count ``n``, the ``total`` and a range number ``b``.

    Ranges end at approximate quantiles, so they are as deep as ``MEDIAN_CUTS`` say wherever the
    values lie. The approximation decides about speed only.
    """
    value = F.col(column).cast("double")
    counted = df.select(value.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    cuts = F.percentile_approx(value, F.array(*map(F.lit, MEDIAN_CUTS)), F.lit(20_000))
    known = df.agg(F.struct(cuts.alias("cuts"), F.count(value).alias("total")))
    told = counted.withColumn("k", known.scalar()).select("v", "n", "k.total", "k.cuts")
    return told.withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")


def median_of(df: DataFrame, column: str) -> Column:
    """The exact median of a numeric column as a scalar subquery (NULL without values).

    Rows are counted by value first, combined map-side. The counts are summed into a few ranges of
    values; a running count over them finds those that hold the two middle places, and only
    their distinct values are put in order.
    """
    placed = _ranges(df, column)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    ranges = placed.groupBy("b", "total").agg(F.sum("n").alias("in_b"))
    along = W.partitionBy("total").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    upto = ranges.withColumn("upto", F.sum("in_b").over(along))
    middle = upto.filter((F.col("upto") >= low) & (F.col("upto") - F.col("in_b") < high)).select(
        "b", (F.col("upto") - F.col("in_b")).alias("before"))
    inside = W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.join(middle, "b").withColumn("last", F.col("before") + F.sum("n").over(inside))
    hit = (F.col("last") >= low) & (F.col("last") - F.col("n") < high)
    both = F.when(F.count_if(hit) == 1, F.max(F.when(hit, F.col("v")))).otherwise(
        (F.min(F.when(hit, F.col("v"))) + F.max(F.when(hit, F.col("v")))) / 2)
    return ranked.agg(both.alias("median")).scalar()


def _lines(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def _score_aggregates(df: DataFrame, column: str) -> list[Column]:
    c = F.col(column)
    return [
        F.avg(c).alias("mean"), median_of(df, column).alias("median"), F.min(c).alias("min"),
        F.max(c).alias("max"), F.stddev_samp(c).alias("std")]


def score_stats(df: DataFrame, column: str = "quality_score") -> DataFrame:
    """Distribution of the score over its non-null values."""
    c = F.col(column)
    return df.agg(
        *_score_aggregates(df, column),
        F.count_if(c >= 20).alias("n_ge_20"), F.count_if(c >= 15).alias("n_ge_15"))


def star_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("stars").alias("mean"), median_of(df, "stars").alias("median"),
        F.min("stars").alias("min"), F.max("stars").alias("max"))


def _completeness_parts(df: DataFrame, columns: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Aggregates, and the report lines made from their results."""
    present = [c for c in columns if c in df.columns]
    aggregates = [F.count("*").alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in present]]
    share = {c: F.col(f"_n_{c}") / F.nullif(F.col("_rows"), F.lit(0)) * 100 for c in present}
    return aggregates, [
        F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("count"),
                 F.round(share[c], 2).alias("percentage")) for c in present]


def completeness(df: DataFrame, columns: Sequence[str] = tx.COMPLETENESS_COLUMNS) -> DataFrame:
    """Non-null count and percentage of each expected column that the table has."""
    aggregates, lines = _completeness_parts(df, columns)
    if not lines:
        return df.sparkSession.createDataFrame([], "column string, count bigint, percentage double")
    return _lines(df.agg(*aggregates), lines)


def mean_completeness(df: DataFrame) -> DataFrame:
    return completeness(df).agg(F.round(F.avg("percentage"), 1).alias("mean_completeness"))


def _structure(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """One row of totals, and the issue lines made from it."""
    present = [c for c in tx.REQUIRED_COLUMNS if c in df.columns]
    missing = [c for c in tx.REQUIRED_COLUMNS if c not in df.columns]
    key = [F.col("full_name")] if "full_name" in present else []
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    groups = df.groupBy(*key).agg(F.count("*").alias("n"), *nulls)
    totals = groups.agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in present])

    def row(issue: str, column: str, n: Column) -> Column:
        return F.struct(F.lit(issue).alias("issue"), F.lit(column).alias("column"),
                        F.coalesce(n, F.lit(0)).cast("long").alias("n"))

    rows = [row("missing column", c, F.lit(1)) for c in missing]
    if key:
        rows.append(row("duplicate rows", "full_name", F.col("dup")))
    return totals, rows + [row("null values", c, F.col(f"null_{c}")) for c in present]


def structure_issues(df: DataFrame) -> DataFrame:
    """Missing required columns, rows in duplicate groups and nulls in required columns.

    Only issues that occur are listed, as ``(issue, column, n)``.
    """
    totals, rows = _structure(df)
    return _lines(totals, rows).filter(F.col("n") > 0)


def _issue_parts(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """Aggregates, and the report lines made from their results."""
    checks: dict[str, tuple[tuple[str, ...], Column]] = {
        "low stars": (("stars",), F.col("stars") < tx.MIN_STARS),
        "no description": (("description",), F.coalesce(F.length("description"), F.lit(0)) == 0),
        "not pushed for 2 years": (
            ("days_since_last_push",), F.col("days_since_last_push") > tx.MAX_DAYS_SINCE_PUSH),
        "no signals": (("ai_keyword_count", "test_keyword_count"),
                       (F.col("ai_keyword_count") == 0) & (F.col("test_keyword_count") == 0)),
    }
    usable = {k: cond for k, (cols, cond) in checks.items() if set(cols) <= set(df.columns)}
    aggregates = [F.count_if(cond).alias(f"_issue_{i}") for i, cond in enumerate(usable.values())]
    return aggregates, [
        F.struct(F.lit(k).alias("issue"), F.col(f"_issue_{i}").alias("n")) for i, k in enumerate(usable)]


def quality_issues(df: DataFrame) -> DataFrame:
    """Counts of questionable rows; checks whose columns are absent are left out."""
    aggregates, lines = _issue_parts(df)
    if not lines:
        return df.sparkSession.createDataFrame([], "issue string, n bigint")
    return _lines(df.agg(*aggregates), lines).filter(F.col("n") > 0)


def _texts(lines: Sequence[Column]) -> Column:
    """The report's sentences for the issues that occur, in order."""
    none = F.array().cast("array<string>")
    if not lines:
        return none

    def text(line: Column) -> Column:
        sentence = F.element_at(F.create_map(*[F.lit(v) for pair in tx.REPORT_TEXTS.items() for v in pair]), line["issue"])
        sentence = F.replace(sentence, F.lit("{n}"), line["n"].cast("string"))
        return F.replace(sentence, F.lit("{column}"), line["column"])

    return F.transform(F.filter(F.array(*lines), lambda line: line["n"] > 0), text)


def report(df: DataFrame) -> DataFrame:
    """The whole report as one row: a JSON text in the column ``report``.

    Two scans: one for all counts and the score, one grouped by name for the structure.
    """
    counts, complete = _completeness_parts(df, tx.COMPLETENESS_COLUMNS)
    issue_counts, issues = _issue_parts(df)
    scores = _score_aggregates(df, "quality_score") if "quality_score" in df.columns else []
    totals, structure = _structure(df)
    issues = [F.struct(i["issue"].alias("issue"), F.lit("").alias("column"), i["n"].alias("n")) for i in issues]
    columns = F.map_from_entries(F.array(*[
        F.struct(c["column"].alias("key"), F.struct(c["count"].alias("count"), c["percentage"].alias("percentage")).alias("value"))
        for c in complete])) if complete else F.create_map().cast("map<string,bigint>")
    quality_scores = F.struct("mean", "median", "min", "max", "std") if scores else F.lit(None).cast("string")
    whole = F.struct(
        F.col("_rows").alias("total_repos"), totals.select(_texts(structure)).scalar().alias("structure_issues"),
        _texts(issues).alias("quality_issues"),
        F.struct(F.col("_rows").alias("total_repos"), columns.alias("enrichment_completeness"),
                 quality_scores.alias("quality_scores")).alias("enrichment_stats"))
    return df.agg(*counts, *issue_counts, *scores).select(F.to_json(whole).alias("report"))
