"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .views import VIEWS, Views, parts_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DERIVED: dict[str, str] = {}


@functools.lru_cache(maxsize=4)
def views(spark: SparkSession, folder: str) -> Views:
    return Views(spark, folder)


def plain(df: DataFrame) -> DataFrame:
    """Columns both engines hash alike: text for lists and times, whole numbers as long."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def register(key: str, query: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    """``query`` gets the views of one folder; ``sql`` names views and CTEs in braces."""
    if key in QUERIES:
        raise KeyError(f"{key} is registered twice")
    QUERIES[key] = lambda spark, folder: plain(query(views(spark, folder)))
    if sql is not None:
        ORACLES[key] = sql


def cte(key: str, sql: str) -> None:
    DERIVED[key] = sql


def oracle_text(sql: str) -> str:
    """The SQL with the views and CTEs it needs put in front."""
    known = {**VIEWS, **DERIVED}
    order: list[str] = []

    def visit(text: str) -> None:
        for part in parts_of(text):
            if part in known and part not in order:
                visit(known[part])
                if part not in order:
                    order.append(part)

    visit(sql)

    def bare(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    head = ",\n".join(f"{p} as (\n{bare(known[p]).strip()}\n)" for p in order)
    return (f"with {head}\n" if head else "") + bare(sql).strip()


# -- pieces of oracle SQL ------------------------------------------------------

def sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sq(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(sq(v) for v in values) + ")"


def count_sql(text: str, terms) -> str:
    """Sum of non-overlapping occurrences in an already lower-cased, non-null text."""
    return "(" + " + ".join(
        f"(length({text}) - length(replace({text}, {sq(t.lower())}, ''))) // {len(t)}" for t in terms
    ) + ")"


def days_sql(ts: str, as_of: str) -> str:
    return (f"cast(floor((epoch_us(timestamp {sq(as_of)}) - epoch_us({ts})) / 86400000000.0) as bigint)")
