"""Chat formatting in budgeted windows, and reading them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tokens
from .common import Kept

#: Marks of the template. They and the other control strings never stand in a formatted text
#: but as marks: a text's own ones get a backslash after their first character.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens of a window, of the cells that turns are dealt to, and of the history it repeats, at most.
BUDGET, SPAN, HISTORY = 2048, 1024, 512
#: Turn numbers of a block of the prefix sums.
BLOCK = 256

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")


def escaped(text: Column) -> Column:
    """One more backslash after the first character of every control string, escaped ones included."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes and line breaks are spelled out as well."""
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(plain)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def unescaped_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(text))


def running(table: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before each one, as column ``name``.

    Sums run within blocks of a key and over the blocks' totals, so that a key with very many rows
    is not sorted in one task. Keys and blocks are not null.
    """
    blocked = table.withColumns({"_block": block, "_value": value})
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("_inside", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(over), F.lit(0))).drop("_total")
    return inside.join(offsets, [*keys, "_block"]).withColumn(name, F.col("_inside") + F.col("_offset")).drop(
        "_block", "_value", "_inside", "_offset")


def windows(turns: DataFrame, content: str, pattern: str) -> DataFrame:
    """``conv_id, window_no, text, loss, n_repeated, n_tokens, over_budget`` of all conversations.

    ``turns`` has ``conv_id, turn, role, text``; a null role or text is empty. Turns are ordered by
    turn (nulls last), role and text; rows that repeat a turn are turns of their own, and rows
    without a conversation form one.

    The tokens of a turn are those of its formatted, escaped piece; pieces are tokenized alone as
    in the window, so ``n_tokens`` is the number of tokens of ``text``. The prefix sum numbers the
    cell in which a turn begins; a cell is as wide as half of what the opening system turn leaves
    of ``BUDGET``, and ``SPAN`` at most. The turns of a cell are a window's new turns, but for one
    wider than the cell, which is its last and has a window of its own, so they fit. Before them
    a window repeats the system turn that opens the conversation and those turns that end it
    before, as many as make up ``HISTORY`` tokens and still fit.
    ``loss`` holds the code point spans of the assistant texts among the new turns, still escaped;
    repeated ones are masked, so each is learned once. ``n_repeated`` is the number of repeated
    turns. A turn is never cut, so ``over_budget`` is true where a turn does not fit, alone or
    beside the system turn, and nowhere else.
    """
    t = turns.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))
    t = t.withColumns({"head": head, "body": escaped(F.col("text"))}).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    t = t.withColumn("n", tokens.token_count(F.col("piece"), content, pattern))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 63) - 1)))
    t = running(t, ["conv"], F.col("block"), [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")], F.col("n"), "before")
    kept = Kept(turns.sparkSession, "turns")
    # every turn has tokens, so ``before`` also numbers the turns of a conversation
    summed = kept.write(t.select(
        "conv", "block", "before", "n", (F.col("role") == "assistant").alias("learned"),
        ((F.col("role") == "system") & (F.col("before") == 0)).alias("opening"), "head", "body", "piece"))
    # the system turn's tokens by conversation and block, so that a key with very many rows is not joined in one task
    first = summed.groupBy("conv", "block").agg(F.coalesce(F.max(F.when(F.col("opening"), F.col("n"))), F.lit(0)).alias("first"))
    first = first.withColumn("always", F.max("first").over(Window.partitionBy("conv"))).drop("first")
    # a system turn that does not fit itself changes no cells
    cell = F.when(F.col("always") < BUDGET, F.least(F.lit(SPAN), F.greatest(
        F.floor((BUDGET - F.col("always")) / 2), F.lit(1)))).otherwise(SPAN).cast("long")
    t = kept.write(summed.join(first, ["conv", "block"]).drop("block").withColumn("cell", cell).withColumn(
        "span", 2 * F.floor(F.col("before") / F.col("cell")) + (F.col("n") > F.col("cell")).cast("long")))
    kept.drop(summed)
    shape = ["conv", "span", "before", "n", "learned", "head", "body", "piece"]
    starts = t.groupBy("conv", "span").agg(F.min("before").alias("start"), F.least(F.lit(HISTORY), BUDGET - F.sum("n") - F.when(
        F.min("before") > 0, F.max("always")).otherwise(0)).alias("room"))
    # a turn can only be repeated by windows that begin within what is left beside the system turn
    reach = F.least(F.lit(HISTORY), F.greatest(BUDGET - F.col("always"), F.lit(0)))
    history = t.where(~F.col("opening") & (F.col("n") <= reach)).withColumn("own", F.col("span")).withColumn("span", F.explode(F.sequence(
        F.col("own"), 2 * F.floor((F.col("before") + reach) / F.col("cell")) + 1))).where("span > own").join(
        starts, ["conv", "span"]).where(F.col("start") - F.col("before") <= F.col("room")).select(*shape, F.lit(1).alias("place"))
    system = t.where("opening").drop("span").join(starts.where("start > 0"), "conv").select(
        *shape, F.lit(0).alias("place"))
    every = t.select(*shape, F.lit(2).alias("place")).unionByName(history).unionByName(system)
    along = Window.partitionBy("conv", "span").orderBy("place", "before").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn(
        "at", F.coalesce(F.sum(F.length("piece")).over(along), F.lit(0)))
    begin = F.col("at") + F.length("head")
    mask = F.when((F.col("place") == 2) & F.col("learned"), F.struct(
        begin.cast("long").alias("start"), (begin + F.length("body")).cast("long").alias("end")))
    grouped = placed.groupBy("conv", "span").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", mask.alias("mask")))).alias("p"),
        F.sum((F.col("place") < 2).cast("int")).alias("n_repeated"), F.sum("n").alias("n_tokens"))
    return grouped.select(
        F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), F.col("span").alias("window_no"),
        F.array_join("p.piece", "").alias("text"), F.filter("p.mask", lambda m: m.isNotNull()).alias("loss"),
        "n_repeated", "n_tokens", (F.col("n_tokens") > BUDGET).alias("over_budget"))


def parse(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns of a formatted window, repeated ones included."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, body = part[:-len(CLOSE)].split("\n", 1)
        out.append((unescaped_role(role), unescaped(body)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, from its windows alone.

    Windows are dealt by conversation and sorted; a digest runs over them one window at a time,
    so a conversation of any length takes the memory of one window.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def done() -> tuple:
            n, turns, chars, loss, formatted_chars = state
            return (None if key == "" else int(key), n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars)

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv, text, loss, repeated in zip(batch["conv"], batch["text"], batch["loss"], batch["n_repeated"]):
                if conv != key or state is None:
                    if state is not None:
                        out.append(done())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for m in loss:
                    body = unescaped(text[m["start"]:m["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame([done()], columns=columns).astype({"conv_id": "Int64"})

    rows = formatted.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "window_no", "text", "loss", "n_repeated")
    return rows.repartition("conv").sortWithinPartitions("conv", "window_no").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
