"""Document quality by ordinal regression: cumulative links over hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .common import resident

#: Labelled documents the model is fitted on at most, size of the hashed space, and training.
TRAINING_DOCUMENTS, BUCKETS, STEPS, RATE, PENALTY = 4000, 1 << 16, 100, 0.4, 1e-5
#: Words a worker remembers the weight of.
MEMORY = 500_000

_SHAPE = [(re.compile(p), r) for p, r in (
    (r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a"), (r"\d", "0"), (r"(.)\1+", r"\1\1"))]
_OTHER = re.compile(r"[\W\d_]+")


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself in lower case, its letters, its shape and its last characters."""
    lower = word.lower()
    if word == lower and word.isalpha():
        letters, shape = word, "a" * min(len(word), 2)
    else:
        letters, shape = _OTHER.sub("", lower), word[:64]
        for pattern, by in _SHAPE:
            shape = pattern.sub(by, shape)
    return (_bucket("w", lower), _bucket("l", letters), _bucket("p", letters[:5]), _bucket("s", shape),
            _bucket("e", word[-2:]))


REPEAT = _bucket("r", "repeat")


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


def repeats(words: Sequence[str]) -> int:
    """Words that equal the one before."""
    return sum(map(str.__eq__, words, words[1:]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """One weight vector for all grades and an ordered threshold below each grade but the lowest."""

    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray
    _memory: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memory": {}}

    def _word(self, word: str) -> float:
        return float(self.weights[list(features(word))].sum())

    def latent(self, text: str | None) -> float:
        """The mean weight of the words; 0 for a text without words."""
        words = words_of(text)
        if not words:
            return 0.0
        if len(self._memory) > MEMORY:
            self._memory.clear()
        new = set(words).difference(self._memory)
        self._memory.update((w, self._word(w)) for w in new)
        total = sum(map(self._memory.__getitem__, words)) + float(self.weights[REPEAT]) * repeats(words)
        for w in new:
            if len(w) > 64:
                del self._memory[w]
        return total / len(words)

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade is at least the k-th) for each k from 1."""
        return sigmoid(latent[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.asarray(self.grades, float))
        return self.grades[0] + tails @ steps if len(steps) else np.full(len(tails), self.grades[0])


def fit(texts: Iterable[str], ratings: Iterable[float]) -> Model:
    """Maximum likelihood of the cumulative logit model, by Adam over the whole sample.

    Thresholds are the first one plus sums of positive gaps, so they stay ordered. With one grade
    the model has no threshold; without any rating it has the single grade 0.
    """
    ratings = list(ratings)
    grades = sorted(set(ratings)) or [0.0]
    k = len(grades) - 1
    if k == 0:
        return Model(grades, np.zeros(0), np.zeros(BUCKETS))
    y = np.array([grades.index(r) for r in ratings])
    rows, columns, values = [], [], []
    memory: dict[str, tuple[int, ...]] = {}
    for i, text in enumerate(texts):
        words = words_of(text)
        hashed = [REPEAT] * repeats(words)
        for w in words:
            if w not in memory:
                memory[w] = features(w)
            hashed += memory[w]
        ids, n = np.unique(np.array(hashed, np.int64), return_counts=True)
        rows.append(np.full(len(ids), i, np.int32))
        columns.append(ids.astype(np.int32))
        values.append((n / max(len(words), 1)).astype(np.float32))
    rows, columns, values = map(np.concatenate, (rows, columns, values))
    n = len(y)
    weights, first, gaps = np.zeros(BUCKETS), 0.0, np.zeros(k - 1)
    state = [np.zeros(BUCKETS + k), np.zeros(BUCKETS + k)]
    for step in range(1, STEPS + 1):
        latent = np.bincount(rows, weights[columns] * values, n)
        thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        tail = sigmoid(latent[:, None] - thresholds[None, :])
        low = np.concatenate([np.ones((n, 1)), tail], 1)[np.arange(n), y]
        high = np.concatenate([tail, np.zeros((n, 1))], 1)[np.arange(n), y]
        p = np.maximum(low - high, 1e-9)
        slope = tail * (1 - tail)
        d_low = np.concatenate([np.zeros((n, 1)), slope], 1)[np.arange(n), y]
        d_high = np.concatenate([slope, np.zeros((n, 1))], 1)[np.arange(n), y]
        d_latent = -(d_low - d_high) / p / n
        d_threshold = np.zeros(k)
        np.add.at(d_threshold, np.maximum(y - 1, 0), np.where(y > 0, d_low / p, 0) / n)
        np.add.at(d_threshold, np.minimum(y, k - 1), np.where(y < k, -d_high / p, 0) / n)
        grad = np.concatenate([
            np.bincount(columns, d_latent[rows] * values, BUCKETS) + PENALTY * weights,
            [d_threshold.sum()], np.cumsum(d_threshold[::-1])[::-1][1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = RATE * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:BUCKETS]
        first -= move[BUCKETS]
        gaps -= move[BUCKETS + 1:]
    return Model(grades, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), weights.astype(np.float32))


def grade(text: Column, shared) -> Column:
    """``struct<expected_grade, tail array>`` of whole texts by the model in the broadcast ``shared``.

    ``tail`` holds the probability of at least the second, third ... grade. A null or empty text
    has the latent value 0. Scores depend on the text alone.
    """
    @F.pandas_udf("expected_grade double, tail array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        key, model = shared.value
        model = resident("quality", "model", key, lambda: model)
        latent = np.array([model.latent(t) for t in texts.where(texts.notna(), None)], float)
        tails = model.tails(latent)
        return pd.DataFrame({"expected_grade": model.expected(tails), "tail": list(tails)})

    return score(text)
