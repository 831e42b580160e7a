"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, resident

#: Signs that count as word characters but are no letters: fractions, circled and Roman numbers and the like.
NUMBER_SIGN = re.compile("[%s]" % "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()))
BEYOND = re.compile("[\U00010000-\U0010ffff]")
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Documents the frequencies are counted over at most, the count from which a word or n-gram
#: is known, and the length of the longest n-gram.
TRAINING_DOCUMENTS, KNOWN_FROM, LONGEST = 4000, 2, 5
#: Words a worker remembers the scores of, and the length of a word that is remembered.
MEMORY, LONGEST_WORD = 300_000, 40
SCHEMA = "lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Runs of letters."""
    if not text.isascii():
        if NUMBER_SIGN.search(text):
            text = NUMBER_SIGN.sub(" ", text)
        if BEYOND.search(text):
            text = BEYOND.sub(lambda m: m[0] if m[0].isalpha() else " ", text)
    return WORD.findall(text)


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_" if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language of words (order 0) and of n-grams of each order.

    ``orders`` lead from a word or n-gram to its row of ``logs``.
    """

    languages: list[str]
    orders: list[dict[str, int]]
    logs: np.ndarray
    _seen: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}, "_rows": []}

    def evidence(self, word: str) -> list[int]:
        """The rows a word is scored by.

        A known word scores by its own frequencies. Any other one takes the longest order in
        which one of its n-grams is known, and the mean over those that are; a word without any
        says nothing.
        """
        row = self.orders[0].get(word)
        if row is not None:
            return [row]
        for n in range(LONGEST, 0, -1):
            known = self.orders[n]
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return found
        return []

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each language given each word, all languages alike beforehand."""
        found = [self.evidence(w) for w in words]
        size = np.array([len(f) for f in found], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        picked = self.logs[np.array([r for f in found for r in f], np.int64)]
        # without any evidence bincount counts, in whole numbers
        mean = np.stack([np.bincount(owner, picked[:, j], len(words)) for j in range(len(self.languages))], 1).astype(float)
        mean /= np.maximum(size, 1)[:, None]
        mean -= mean.max(1, keepdims=True)
        return mean - np.log(np.exp(mean).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``(language, score)`` of each text.

        The language has the highest sum of word scores, the first by name among equals; the score
        is the mean over the words of the probability they give it.
        """
        lists = [words_of(t) if t and self.languages else [] for t in texts]
        if self._rows and len(self._rows[0]) > MEMORY:
            self._seen, self._rows = {}, []
        seen = self._seen
        new = list(set().union(*lists).difference(seen))
        if new:
            first = len(self._rows[0]) if self._rows else 0
            seen.update(zip(new, range(first, first + len(new))))
            self._rows.append(self.word_scores([w.lower() for w in new]))
            self._rows = [np.concatenate(self._rows)]
        rows = self._rows[0] if self._rows else np.zeros((0, 1))
        out = []
        for words in lists:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            logs = rows[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))]
            best = int(np.argmax(logs.sum(0)))
            out.append((self.languages[best], float(np.exp(logs[:, best]).mean())))
        for w in new:  # very long words would outgrow the memory
            if len(w) > LONGEST_WORD:
                del seen[w]
        return out


def train(documents: DataFrame, n: int = TRAINING_DOCUMENTS) -> Model:
    """A model of the ``text`` and non-null ``lang`` of at most ``n`` documents, drawn by hash.

    Words and n-grams are counted in the tasks that read the documents and summed once; only
    counts of the bounded sample reach the driver. Nothing to learn from gives a model without
    languages, which calls every text ``und``.
    """
    rows = bounded_sample(
        documents.select("doc_id", "lang", "text").where(
            F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()), "doc_id", n)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.setdefault(lang, Counter()).update(w.lower() for w in words_of(text))
            found = [(lang, w, c) for lang, words in counts.items() for w, c in words.items()]
            yield pd.DataFrame(found, columns=["lang", "word", "n"])

    counted = rows.repartition(8).mapInPandas(count, "lang string, word string, n long")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    return fit([tuple(r) for r in words.itertuples(index=False)])


def fit(counts: list[tuple[str, str, int]]) -> Model:
    """The model of ``(language, word, count)`` rows; add-one-half smoothing within each order."""
    languages = sorted({lang for lang, _, _ in counts})
    tables = {lang: [Counter() for _ in range(LONGEST + 1)] for lang in languages}
    for lang, word, n in counts:
        orders = tables[lang]
        orders[0][word] += n
        for order in range(1, LONGEST + 1):
            known = orders[order]
            for g in grams(word, order):
                known[g] += n
    rows, logs = [], [np.zeros((0, len(languages)), np.float32)]
    first = 0
    for order in range(LONGEST + 1):
        total: Counter = Counter()
        for lang in languages:
            total.update(tables[lang][order])
        kept = [g for g, n in total.items() if n >= KNOWN_FROM]
        table = np.array([[tables[lang][order].get(g, 0) for lang in languages] for g in kept]).reshape(len(kept), len(languages))
        sums = np.array([tables[lang][order].total() for lang in languages])
        logs.append((np.log(table + 0.5) - np.log(sums + 0.5 * len(total) + 0.5)).astype(np.float32))
        rows.append({g: first + i for i, g in enumerate(kept)})
        first += len(kept)
    return Model(languages, rows, np.concatenate(logs))


def language(text: Column, shared) -> Column:
    """``struct<lang_pred, score>`` of whole texts by the model in the broadcast ``shared``.

    ``lang_pred`` is one of the learned languages, or ``und`` with score 0 where the text is null,
    empty or without a letter. Equal texts get equal results wherever they stand.
    """
    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = resident("language", "model", shared.value[0], lambda: shared.value[1])
        found = model.predict(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(text)
