"""Quality rules: text statistics and a learned decision list over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Labelled documents the list is learned from at most, and the bounds of a rule.
TRAINING_DOCUMENTS, MOST_CONDITIONS, MOST_RULES, PRECISION, LEAST_COVERED, CUTS = 8000, 4, 12, 0.9, 8, 64
WINDOW = 5
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of one ASCII character that is neither letter nor digit.
_BARE = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
MARKS = "!?;:\"'()[]{}=+/\\_~^@"
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_upper long, n_digits long, n_marks long, n_distinct long, n_adjacent long, n_bare long")

#: The features of a rule, as SQL over the statistics. An empty denominator gives 0.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "coalesce(try_divide(word_chars, n_words), 0)",
    "symbol_share": "coalesce(try_divide(n_symbols, word_chars), 0)",
    "mark_share": "coalesce(try_divide(n_marks, word_chars), 0)",
    "upper_share": "coalesce(try_divide(n_upper, word_chars), 0)",
    "digit_share": "coalesce(try_divide(n_digits, word_chars), 0)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0)",
    "distinct_share": "coalesce(try_divide(n_distinct, n_words), 0)",
    "adjacent_share": "coalesce(try_divide(n_adjacent, n_words), 0)",
    "bare_share": "coalesce(try_divide(n_bare, n_words), 0)",
}

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list) -> int:
    """Words that lie in a five-word window found twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        window = mix(window * _MIX + hashed[i:i + n])
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


_UPPER = np.array([chr(c).isupper() for c in range(0x600)] + [False])
_DIGIT = np.array([chr(c).isdigit() for c in range(0x600)] + [False])


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics in the order of ``SCHEMA``; zeros for a null text.

    Words are runs of other characters than the six ASCII blanks. Splitting the UTF-8 bytes
    finds the same runs.
    """
    if not text:
        return (0,) * 12
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in lines:
        if line.strip(BLANKS):
            n_lines += 1
            if line in seen:
                n_dup += 1
            seen.add(line)
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x600)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), n_dup,
            repeated_words(words), n_lines, int(_UPPER[points].sum()), int(_DIGIT[points].sum()),
            sum(map(text.count, MARKS)), len(set(words)),
            sum(map(bytes.__eq__, words, words[1:])), sum(map(_BARE.__contains__, words)))


def measure(text: Column) -> Column:
    """The statistics of whole texts as a struct."""
    @F.pandas_udf(SCHEMA)
    def stats(texts: pd.Series) -> pd.DataFrame:
        rows = [statistics(t) for t in texts.where(texts.notna(), None)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")], dtype="int64")

    return stats(text)


#: Documents that fail whatever the list says.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        v = table[self.feature].to_numpy()
        return v >= self.cut if self.at_least else v < self.cut

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.cut!r}D"


def covers(rule: tuple[Condition, ...], table: pd.DataFrame) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(table) for c in rule), np.ones(len(table), bool))


def grow(table: pd.DataFrame, bad: np.ndarray) -> tuple[Condition, ...]:
    """Add the condition with the highest information gain until no good document is covered."""
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(table), bool)
    while len(rule) < MOST_CONDITIONS:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        best = (1e-9, None)
        for feature in FEATURES:
            values = table[feature].to_numpy()[inside]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS), method="nearest"))
            for cut in cuts:
                for at_least in (True, False):
                    hit = values >= cut if at_least else values < cut
                    p1 = int((hit & bad[inside]).sum())
                    n1 = int(hit.sum()) - p1
                    if not p1:
                        continue
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                    if gain > best[0]:
                        best = (gain, Condition(feature, at_least, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(table)
    return rule


def prune(rule: tuple[Condition, ...], table: pd.DataFrame, bad: np.ndarray) -> tuple[Condition, ...]:
    """The shortest beginning of the rule with the best share of bad minus good on other documents."""
    def worth(r):
        hit = covers(r, table)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / max(p + n, 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(table: pd.DataFrame) -> list[tuple[Condition, ...]]:
    """Rejecting rules by sequential covering.

    ``table`` has the features, ``bad`` and ``part`` (0, 1: grow; 2: prune). A rule is accepted when
    at least ``PRECISION`` of what it covers on the pruning part is bad and it covers
    ``LEAST_COVERED`` bad documents in all; what it covers is taken out and the next one is grown.
    A table without bad or without good documents gives no rule: all are kept.
    """
    rules: list[tuple[Condition, ...]] = []
    rest = table
    while len(rules) < MOST_RULES:
        grown, other = rest[rest["part"] < 2], rest[rest["part"] == 2]
        rule = grow(grown, grown["bad"].to_numpy(bool))
        rule = prune(rule, other, other["bad"].to_numpy(bool)) if rule else ()
        if not rule:
            break
        hit, bad = covers(rule, other), other["bad"].to_numpy(bool)
        covered = covers(rule, rest)
        if (covered & rest["bad"].to_numpy(bool)).sum() < LEAST_COVERED or (hit & bad).sum() < PRECISION * max(hit.sum(), 1) or not hit.any():
            break
        rules.append(rule)
        rest = rest[~covered]
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The list as one ordered Spark expression over the statistics: false for a rejected document."""
    out = F.when(F.expr(BASE_FAILED), False)
    for rule in rules:
        out = out.when(F.expr(" and ".join(c.sql() for c in rule)), False)
    return out.otherwise(True)
