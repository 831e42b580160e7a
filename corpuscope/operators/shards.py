"""The sharded search plan, its evaluation over a corpus, and coverage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import taxonomy as tx
from ..functions import text as fx
from ..functions.dates import utc_date
from .ranking import top_k_per_group

KEYS = ("strategy", "term", "other", "shard")
INTERSECTION, LANGUAGE, PHRASE, PERIOD = "intersection", "language", "phrase", "period"


def _star_label(low: int, high: int | None) -> str:
    return f"stars:>={low}" if high is None else f"stars:{low}..{high}"


def _terms(values: Sequence[str], kind: str) -> Column:
    return F.posexplode(fx.array_of(values)).alias(f"{kind}_ord", kind)


def _star_shards(ranges: Sequence[tuple[int, int | None]]) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(i).alias("shard"), F.lit(low).cast("long").alias("star_lo"),
                 F.lit(high).cast("long").alias("star_hi"), F.lit(_star_label(low, high)).alias("part"))
        for i, (low, high) in enumerate(ranges)]))


def _time_shards(ranges: Sequence[tuple[str, str]], min_stars: int) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(i).alias("shard"), F.lit(lo).alias("created_lo"), F.lit(hi).alias("created_hi"),
                 F.lit(f"created:{lo}..{hi} stars:>={min_stars}").alias("part"))
        for i, (lo, hi) in enumerate(ranges)]))


def _quoted(term: str) -> Column:
    return F.concat(F.lit('"'), F.col(term), F.lit('"'))


def shard_plan(spark: SparkSession, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """All shard queries, numbered in order and without duplicates.

    Each strategy spreads one row over the taxonomy's lists by successive explodes. The
    plan's size follows from the taxonomy alone (:func:`plan_size`), never from the corpus.
    """
    one = spark.range(1).select()
    no_text, no_long = F.lit(None).cast("string"), F.lit(None).cast("long")

    def finish(df: DataFrame, number: int, strategy: str, term: str, other: Column,
               query: Column, second: Column) -> DataFrame:
        have = set(df.columns)
        return df.select(
            F.lit(number).alias("strategy_no"), F.lit(strategy).alias("strategy"),
            F.col(f"{term}_ord").alias("ord1"), second.alias("ord2"), "shard",
            F.col(term).alias("term"), other.alias("other"), query.alias("query"),
            *[(F.col(c) if c in have else no_long).alias(c) for c in ("star_lo", "star_hi")],
            *[(F.col(c) if c in have else no_text).alias(c) for c in ("created_lo", "created_hi")],
        )

    ai = one.select(_terms(tax.genai_keywords, "ai"))
    pairs = ai.select("*", _terms(tax.testing_keywords, "test"))
    s1 = pairs.select("*", _star_shards(tax.star_ranges))
    s2 = ai.select("*", _terms(tax.languages, "lang")).select("*", _star_shards(tax.star_ranges))
    s3 = one.select(_terms(tax.phrases, "phrase")).select(
        "*", _star_shards(tax.star_ranges[:tax.phrase_star_ranges]))
    s4 = one.select(_terms(tax.genai_keywords[:tax.time_keywords], "ai")).select(
        "*", _time_shards(tax.time_shards, tax.min_stars))
    plan = (
        finish(s1, 1, INTERSECTION, "ai", F.col("test"),
               F.concat_ws(" ", _quoted("ai"), _quoted("test"), "part"), F.col("test_ord"))
        .unionByName(finish(s2, 2, LANGUAGE, "ai", F.col("lang"), F.concat_ws(
            " ", _quoted("ai"), F.concat(F.lit("language:"), F.col("lang")), "part"), F.col("lang_ord")))
        .unionByName(finish(s3, 3, PHRASE, "phrase", F.lit(""),
                            F.concat_ws(" ", _quoted("phrase"), "part"), F.lit(0)))
        .unionByName(finish(s4, 4, PERIOD, "ai", F.lit(""),
                            F.concat_ws(" ", _quoted("ai"), "part"), F.lit(0)))
    )
    return number_queries(dedup_queries(plan))


PLAN_ORDER = ("strategy_no", "ord1", "ord2", "shard")


def dedup_queries(plan: DataFrame) -> DataFrame:
    """The first plan row of each query text."""
    return top_k_per_group(plan, ["query"], [F.col(c) for c in PLAN_ORDER], 1).drop("rank")


def number_queries(plan: DataFrame) -> DataFrame:
    """Adds ``query_id``, counting from 0 in plan order.

    The whole plan is one sorted array here; its length is bounded by the taxonomy.
    """
    columns = [*PLAN_ORDER, *[c for c in plan.columns if c not in PLAN_ORDER]]
    ordered = plan.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    numbered = ordered.select(F.posexplode("rows").alias("query_id", "r"))
    return numbered.select(F.col("query_id").cast("long"), "r.*")


def plan_size(tax: tx.Taxonomy = tx.DEFAULT) -> int:
    """Upper bound on the rows of :func:`shard_plan`."""
    stars = len(tax.star_ranges)
    return (
        len(tax.genai_keywords) * stars * (len(tax.testing_keywords) + len(tax.languages))
        + len(tax.phrases) * min(stars, tax.phrase_star_ranges)
        + min(len(tax.genai_keywords), tax.time_keywords) * len(tax.time_shards)
    )


def simple_plan(spark: SparkSession, tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """One query per AI keyword, above the star minimum."""
    terms = spark.range(1).select(_terms(tax.genai_keywords, "term"))
    return terms.select(
        F.col("term_ord").cast("long").alias("query_id"), "term",
        F.lit(tax.min_stars).cast("long").alias("star_lo"),
        F.concat(_quoted("term"), F.lit(f" stars:>={tax.min_stars}")).alias("query"))


def search_text() -> Column:
    """What a search looks at: name, description and topics."""
    return F.lower(F.concat_ws(
        " ", F.col("full_name"), F.coalesce(F.col("description"), F.lit("")),
        F.array_join(F.coalesce(F.col("topics"), F.array().cast("array<string>")), " ")))


def _matching(text: Column, terms: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[
        F.when(text.contains(t.lower()), F.lit(t)) for t in terms])) if terms else fx.array_of(())


def _star_ids(tax: tx.Taxonomy) -> Column:
    stars = F.col("stars")
    return F.array_compact(F.array(*[
        F.when((stars >= low) & ((stars <= high) if high is not None else F.lit(True)), F.lit(i))
        for i, (low, high) in enumerate(tax.star_ranges)]))


def _time_ids(tax: tx.Taxonomy) -> Column:
    day = utc_date("created_at")
    ids = F.array_compact(F.array(*[
        F.when(day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(i))
        for i, (lo, hi) in enumerate(tax.time_shards)]))
    return F.when(F.col("stars") >= tax.min_stars, ids).otherwise(F.array().cast("array<int>"))


def _keys(strategy: str, terms: Column, others: Column, shards: Column) -> Column:
    return F.flatten(F.transform(terms, lambda t: F.flatten(F.transform(
        others, lambda o: F.transform(shards, lambda s: F.struct(
            F.lit(strategy).alias("strategy"), t.alias("term"), o.alias("other"),
            s.alias("shard")))))))


def simple_search(repos: DataFrame, plan: DataFrame, tax: tx.Taxonomy = tx.DEFAULT,
                  carry: Sequence[str] | None = None) -> DataFrame:
    """Every (query, repository) pair of the one-keyword plan; ``carry`` as in :func:`shard_search`."""
    carry = repos.columns if carry is None else carry
    matched = repos.filter(F.col("stars") >= tax.min_stars).select(
        *carry, F.explode_outer(_matching(search_text(), tax.genai_keywords)).alias("term")
    ).filter(F.col("term").isNotNull())
    return matched.join(plan.select("query_id", "query", "term"), "term").select("query_id", "query", *carry)


def shard_search(repos: DataFrame, plan: DataFrame, tax: tx.Taxonomy = tx.DEFAULT,
                 carry: Sequence[str] | None = None) -> DataFrame:
    """Every (query, repository) pair in which the repository meets the shard query.

    ``carry`` names the repository's columns that every pair is given; all unless set. What
    only the chosen pairs need is better joined after the choice.

    Each repository computes the shard keys it belongs to from its matched terms, star
    buckets, language and creation period, and meets the plan in an equi join on them; the
    repositories are read once and not shuffled. Adjacent star ranges share their end
    points, so a repository may fall into two.
    """
    known = repos.withColumn("_text", search_text())
    matched = known.withColumns({
        "_ai": _matching(F.col("_text"), tax.genai_keywords),
        "_test": _matching(F.col("_text"), tax.testing_keywords),
        "_phrase": _matching(F.col("_text"), tax.phrases),
        "_early": _matching(F.col("_text"), tax.genai_keywords[:tax.time_keywords]),
        "_lang": F.when(F.col("language").isin(*tax.languages), F.array("language"))
                  .otherwise(F.array().cast("array<string>")),
        "_stars": _star_ids(tax), "_time": _time_ids(tax),
    })
    none = F.array(F.lit(""))
    keys = F.concat(
        _keys(INTERSECTION, F.col("_ai"), F.col("_test"), F.col("_stars")),
        _keys(LANGUAGE, F.col("_ai"), F.col("_lang"), F.col("_stars")),
        _keys(PHRASE, F.col("_phrase"), none, F.col("_stars")),
        _keys(PERIOD, F.col("_early"), none, F.col("_time")),
    )
    # outer: for a plain inline Spark would copy the whole key expression into a filter
    carry = repos.columns if carry is None else carry
    wanted = matched.select(*carry, F.inline_outer(keys).alias(*KEYS)).filter(
        F.col("strategy").isNotNull())
    lookup = plan.select("query_id", "query", *KEYS)
    return wanted.join(lookup, list(KEYS)).select("query_id", "query", *carry)


def shard_predicate(repos: DataFrame, terms: Sequence[str], star_lo: int = tx.MIN_STARS,
                    star_hi: int | None = None, language: str | None = None,
                    created: tuple[str, str] | None = None,
                    tax: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Repositories that meet one shard query, above the taxonomy's star minimum."""
    text = search_text()
    condition = (F.col("stars") >= star_lo) & (F.col("stars") >= tax.min_stars)
    for term in terms:
        condition &= text.contains(term.lower())
    if star_hi is not None:
        condition &= F.col("stars") <= star_hi
    if language is not None:
        condition &= F.col("language") == language
    if created is not None:
        condition &= utc_date("created_at").between(
            F.lit(created[0]).cast("date"), F.lit(created[1]).cast("date"))
    return repos.filter(condition)


def first_seen(hits: DataFrame) -> DataFrame:
    """Per repository the first query that found it. A plain minimum, combined map-side."""
    return hits.groupBy("full_name").agg(F.min("query_id").alias("first_query_id"))


SORT_COLUMNS = {"stars": "stars", "forks": "forks", "updated": "updated_at"}


def search_topk(hits: DataFrame, max_results: int, sort: str = "stars", descending: bool = True) -> DataFrame:
    """The first ``max_results`` hits of each query in the given order.

    Queries are ranked in salted parts first: one broad query may own most hits. Spark cuts
    each part to the limit before it shuffles, as long as the limit does not exceed
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000 unless set).
    """
    column = F.col(SORT_COLUMNS[sort])
    order = [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col("full_name")]
    return top_k_per_group(hits, ["query_id"], order, max_results, spread=["full_name"])


def shard_coverage(hits: DataFrame, plan: DataFrame, cap: int = tx.SEARCH_RESULT_CAP) -> DataFrame:
    """Hits per query, and whether a search returning ``cap`` rows would cut them off."""
    counted = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return plan.select("query_id", "query").join(counted, "query_id", "left").select(
        "query_id", "query", n.alias("n_hits"), (n > cap).alias("truncated"))


def acceptance_stats(hits: DataFrame, accepted: DataFrame) -> DataFrame:
    """Hits found and repositories newly accepted per query, and in total (query -1).

    ``accepted`` holds the ``full_name`` of repositories that pass the filters; each counts
    for the first query that finds it. The second aggregation runs over one row per query.
    """
    found = hits.groupBy("query_id").agg(F.count("*").alias("found"))
    new = (
        first_seen(hits.join(accepted.select("full_name").distinct(), "full_name", "left_semi"))
        .groupBy(F.col("first_query_id").alias("query_id")).agg(F.count("*").alias("accepted"))
    )
    per_query = found.join(new, "query_id", "left").withColumn(
        "accepted", F.coalesce(F.col("accepted"), F.lit(0).cast("long")))
    return per_query.rollup("query_id").agg(
        F.sum("found").alias("found"), F.sum("accepted").alias("accepted")
    ).withColumn("query_id", F.coalesce(F.col("query_id"), F.lit(-1).cast("long")))


def query_stats(plan: DataFrame) -> DataFrame:
    """How many queries have a language part, a creation period and a range."""
    return plan.agg(
        F.count("*").alias("n_queries"),
        F.count_if(F.col("query").contains("language:")).alias("with_language"),
        F.count_if(F.col("query").contains("created:")).alias("with_period"),
        F.count_if(F.col("query").contains("..")).alias("with_range"))
