"""Ranking, deduplication, selection and the moving average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SALTS = 64


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    spread: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """The first ``k`` rows of every group, with a ``rank`` column.

    A hot group would land in one task, so with ``spread`` columns the group is first cut
    into ``salts`` parts by their hash. The first k of a group are among the first k of
    its parts, so ranking the parts and then their winners is exact and the last step sees
    at most ``salts * k`` rows per group.
    """
    if spread:
        salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_part_rank", F.row_number().over(part))
            .filter(F.col("_part_rank") <= k).drop("_salt", "_part_rank")
        )
    group = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= k)


def _best_first(df: DataFrame) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in ("quality_score", "stars") if c in df.columns]


def dedup_best(df: DataFrame, tie: Sequence[str] = ("html_url",)) -> DataFrame:
    """One row per ``full_name``: the one with the highest quality score, then most stars.

    The rank filter sits right on the window, so Spark keeps one row per key and map task
    before it shuffles; a name that fills a third of the table stays cheap.
    """
    order = _best_first(df) + [F.col(c).asc_nulls_last() for c in tie if c in df.columns]
    order = order or [F.col("full_name")]
    return top_k_per_group(df, ["full_name"], order, 1).drop("rank")


def sort_output(df: DataFrame) -> DataFrame:
    """Best first by quality score and stars, whichever exist; the name settles ties."""
    return df.orderBy(*_best_first(df), F.col("full_name"))


def select_top(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with most AI keywords (or, without that column, most stars)."""
    by = "ai_keyword_count" if "ai_keyword_count" in df.columns else "stars"
    return df.orderBy(F.col(by).desc_nulls_last(), F.col("full_name")).limit(n)


def select_random(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run and partitioning."""
    draw = F.md5(F.concat_ws("#", F.col("full_name"), F.lit(str(seed))))
    return df.orderBy(draw, F.col("full_name")).limit(n)


def select_all(df: DataFrame) -> DataFrame:
    return df


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent non-null values of a column; the value settles ties."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col("value")).limit(n)
    )


def top_languages(languages: DataFrame, n: int = 3) -> DataFrame:
    """Per repository its ``n`` languages with most bytes, as an ordered array.

    Ties go by name. At most ``n`` values per repository are ever collected.
    """
    per_language = languages.groupBy("full_name", "language").agg(F.sum("bytes").alias("bytes"))
    ranked = top_k_per_group(
        per_language, ["full_name"], [F.col("bytes").desc(), F.col("language")], n)
    return ranked.groupBy("full_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "language"))), lambda s: s["language"]
        ).alias("language_distribution")
    )


def moving_avg_eta(log: DataFrame, window: int = 10, block: int = 100_000) -> DataFrame:
    """Estimated time left after each query of a run.

    ``log`` holds ``run_id``, ``query_no`` (0-based; numbers may be missing), ``seconds`` and
    ``total``, the length of the run's plan. The mean of the last ``window`` durations is
    multiplied by the queries still to run. Rows with one number go by ``seconds``, then ``total``.

    A run is cut into blocks by the query's number, so a long run spreads over many tasks and is
    shuffled once. The last ``window - 1`` durations of each block form an array, cut to that size
    before the shuffle; from the arrays before it a block knows what its first rows still need, so
    the result is that of one window over the whole run, whatever ``block`` is.
    """
    halo = window - 1
    order = ["query_no", "seconds", "total"]
    blocked = log.withColumn("_block", F.coalesce(F.floor(F.col("query_no") / block), F.lit(-1)))
    inside = W.partitionBy("run_id", "_block").orderBy(*order)
    recent = inside.rowsBetween(-halo, 0)
    rolled = (
        blocked.withColumn("_at", F.row_number().over(inside) - 1)
        .withColumn("_sum", F.sum("seconds").over(recent)).withColumn("_n", F.count("seconds").over(recent))
    )
    ends = top_k_per_group(blocked.select("run_id", "_block", *order), ["run_id", "_block"], [F.col(c).desc() for c in order], halo)
    latest = F.transform(F.array_sort(F.collect_list(F.struct("rank", "seconds"))), lambda r: F.struct(
        r["seconds"].cast("double").alias("s")))
    before = W.partitionBy("run_id").orderBy("_block").rowsBetween(-max(halo, 1), -1)
    # the arrays of the blocks before, the nearest first, each from its last row backwards
    edges = ends.groupBy("run_id", "_block").agg(latest.alias("_latest")).select(
        F.col("run_id").alias("_run"), F.col("_block").alias("_of"),
        F.slice(F.flatten(F.reverse(F.collect_list("_latest").over(before))), 1, max(halo, 1)).alias("_halo"))
    joined = rolled.join(edges, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_block") == F.col("_of")), "left")
    lacking = F.greatest(F.lit(halo) - F.col("_at"), F.lit(0))
    more = F.filter(F.slice(F.coalesce("_halo", F.array().cast("array<struct<s:double>>")), 1, lacking), lambda r: r["s"].isNotNull())
    total = F.aggregate(more, F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)), lambda t, r: t + r["s"])
    timed = (
        joined.withColumn("avg_seconds", total / F.nullif(F.col("_n") + F.size(more), F.lit(0)))
        .drop("_block", "_at", "_sum", "_n", "_run", "_of", "_halo")
        .withColumn("remaining", F.col("total") - F.col("query_no") - 1)
        .withColumn("eta_seconds", F.col("avg_seconds") * F.col("remaining"))
    )
    return timed.withColumn("eta", format_eta(F.col("eta_seconds"), F.col("query_no")))


def format_eta(seconds: Column, query_no: Column) -> Column:
    def whole(c: Column) -> Column:
        return c.cast("long").cast("string")

    minutes = F.concat(whole(seconds / 60), F.lit("m "), whole(seconds % 60), F.lit("s"))
    hours = F.concat(whole(seconds / 3600), F.lit("h "), whole((seconds % 3600) / 60), F.lit("m"))
    return (
        F.when(query_no == 0, "calculating...")
        .when(seconds < 60, F.concat(whole(seconds), F.lit("s")))
        .when(seconds < 3600, minutes).otherwise(hours)
    )
