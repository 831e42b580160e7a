"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .common import resident

#: Labelled documents that are drawn at most, and how many of each class the field is fitted on: the first
#: in the order of a hash of the id.
TRAINING_DOCUMENTS, PER_CLASS = 8000, 700
#: A word is a toxic token of a toxic document if it or its beginning has so many surroundings in toxic documents,
#: such a number of them for each toxic document, and log odds so high.
TOKEN_DOCUMENTS, TOKEN_SHARE, TOKEN_ODDS = 4, 0.01, 3.0
BUCKETS, STEPS, RATE, PENALTY = 1 << 16, 60, 0.4, 1e-4
#: Tokens of a block. A longer run without an end mark is several blocks that hand on their states.
BLOCK = 32
MEMORY = 500_000
#: Marginal from which a token counts for the document.
FAINT = 0.1
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
SCHEMA = "score double, spans array<struct<start:int,end:int,probability:double>>"


def features(token: str) -> tuple[int, ...]:
    """Hashed features: the word, its beginnings, its end and its length class."""
    w = token.lower()
    parts = [f"w:{w}", *(f"b{n}:{w[:n]}" for n in (3, 4, 5, 6) if len(w) >= n), f"e:{w[-3:]}", f"n:{min(len(w), 12)}"]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def chains(lists: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Document, block and place in the block of every word, whether a block goes on from the one before, and the words in order."""
    flat = [t for x in lists for t in x]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if not flat:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, bool), []
    ends = np.fromiter((t in ENDS for t in flat), bool, len(flat))
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | ends[:-1]])
    run = np.cumsum(new) - 1
    keep = ~ends
    owner, run = owner[keep], run[keep]
    first = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0)) if len(run) else run
    place = np.arange(len(run)) - begin
    cut = first | (place % BLOCK == 0)
    return owner, np.cumsum(cut) - 1, place % BLOCK, ~first[cut], [t for t, k in zip(flat, keep) if k]


def _handed_on(weight: np.ndarray, there: np.ndarray, t: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward state each block begins with and the backward one it ends with, both as shares.

    A block is a product of 2 x 2 matrices, so the states of a run of any length are passed from
    block to block; all runs are passed together.
    """
    n = len(follows)
    before, behind = np.tile([1.0, 0.0], (n, 1)), np.ones((n, 2))
    if not follows.any():
        return before, behind
    part = np.flatnonzero(follows | np.append(follows[1:], False))
    matrix = np.tile(np.eye(2), (len(part), 1, 1))
    for i in range(len(weight)):
        on = there[i, part]
        step = np.tile(t[:2], (len(part), 1, 1))
        if i == 0:
            step[~follows[part]] = t[2]
        step[:, :, 1] *= weight[i, part, None]
        after = matrix @ step
        matrix[on] = (after / after.sum((1, 2), keepdims=True))[on]
    whole = np.zeros((n, 2, 2))
    whole[part] = matrix
    run = np.cumsum(~follows) - 1
    turn = np.arange(n) - np.flatnonzero(~follows)[run]
    for k in range(1, int(turn.max()) + 1):
        at = np.flatnonzero(turn == k)
        state = (before[at - 1, None, :] @ whole[at - 1])[:, 0]
        before[at] = state / state.sum(1, keepdims=True)
    for k in range(int(turn.max()), 0, -1):
        at = np.flatnonzero(turn == k)
        state = (whole[at] @ behind[at][:, :, None])[:, :, 0]
        behind[at - 1] = state / state.sum(1, keepdims=True)
    return before, behind


def marginals(emission: np.ndarray, chain: np.ndarray, place: np.ndarray, trans: np.ndarray,
              follows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the expected transitions, by forward and backward passes.

    ``emission`` is the log weight of the toxic tag against the other one; ``trans[a, b]`` the log
    weight of tag b after a, ``trans[2]`` that at the beginning. ``chain`` numbers blocks of tokens;
    one that ``follows`` goes on from the block before it. All blocks are passed together.
    """
    n = int(chain[-1]) + 1 if len(chain) else 0
    width = int(place.max()) + 1 if len(place) else 0
    follows = np.zeros(n, bool) if follows is None else follows
    weight = np.ones((width, n))
    there = np.zeros((width, n), bool)
    weight[place, chain] = np.exp(np.clip(emission, -30, 30))
    there[place, chain] = True
    t = np.exp(np.clip(trans, -30, 30))
    before, behind = _handed_on(weight, there, t, follows)
    forward = np.zeros((width, n, 2))
    for i in range(width):
        p0, p1 = (before if i == 0 else forward[i - 1]).T
        # a run begins with the state (1, 0) and the weights of a beginning
        s = np.where(follows[:, None, None], t[:2], t[2]) if i == 0 else t[None, :2]
        a0, a1 = p0 * s[:, 0, 0] + p1 * s[:, 1, 0], (p0 * s[:, 0, 1] + p1 * s[:, 1, 1]) * weight[i]
        total = a0 + a1
        forward[i, :, 0], forward[i, :, 1] = a0 / total, a1 / total
    b0, b1 = behind.T.copy()
    toxic = np.zeros((width, n))
    expected = np.zeros((3, 2))
    for i in range(width - 1, -1, -1):
        # a place beyond the block's end passes nothing back
        f0, f1 = forward[i, :, 0], forward[i, :, 1]
        total = f0 * b0 + f1 * b1
        toxic[i] = f1 * b1 / total
        w1 = weight[i] * b1
        p0, p1 = (before if i == 0 else forward[i - 1]).T
        joint = np.stack([p0 * t[0, 0] * b0, p0 * t[0, 1] * w1, p1 * t[1, 0] * b0, p1 * t[1, 1] * w1])
        on = there[i] if i else follows
        expected[:2] += (joint / joint.sum(0))[:, on].sum(1).reshape(2, 2)
        if i:
            n0 = t[0, 0] * b0 + t[0, 1] * w1
            n1 = t[1, 0] * b0 + t[1, 1] * w1
            scale = n0 + n1
            b0, b1 = np.where(on, n0 / scale, b0), np.where(on, n1 / scale, b1)
        else:
            expected[2] = [(1 - toxic[0])[~follows].sum(), toxic[0][~follows].sum()]
    return toxic[place, chain], expected


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    #: Intercept and slope of the document score over the log of the summed evidence.
    link: tuple[float, float]
    _memory: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memory": {}}

    def _emissions(self, words: list[str]) -> np.ndarray:
        if len(self._memory) > MEMORY:
            self._memory.clear()
        new = set(words).difference(self._memory)
        w = self.weights
        self._memory.update((t, float(sum(w[i] for i in features(t)))) for t in new)
        out = np.fromiter(map(self._memory.__getitem__, words), float, len(words))
        for t in new:
            if len(t) > 48:
                del self._memory[t]
        return out

    def evidence(self, texts: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Summed -log P(not toxic) of the tokens that may be toxic, and all tokens' probabilities.

        Tokens below ``FAINT`` are left out, so that length alone makes no document toxic.
        """
        owner, chain, place, follows, words = chains([TOKEN.findall(t) for t in texts])
        p, _ = marginals(self._emissions(words), chain, place, self.trans, follows)
        total = np.bincount(owner, np.where(p < FAINT, 0, -np.log1p(-np.minimum(p, 1 - 1e-12))), len(texts))
        return total, np.split(p, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])

    def score(self, total: np.ndarray) -> np.ndarray:
        a, b = self.link
        return 1 / (1 + np.exp(-np.clip(a + b * np.log(total + 1e-3), -40, 40)))

    def predict(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Document scores, and the spans of neighbouring tokens with a marginal of one half or more."""
        texts = [t or "" for t in texts]
        total, each = self.evidence(texts)
        spans: list[list[tuple[int, int, float]]] = []
        for text, p in zip(texts, each):
            found: list[tuple[int, int, float]] = []
            if (p >= 0.5).any():
                at = [m.span() for m in TOKEN.finditer(text) if m[0] not in ENDS]
                last = -2
                for i in np.flatnonzero(p >= 0.5):
                    if i == last + 1:
                        found[-1] = (found[-1][0], at[i][1], max(found[-1][2], float(p[i])))
                    else:
                        found.append((*at[i], float(p[i])))
                    last = int(i)
            spans.append(found)
        return self.score(total), spans


def beginnings(word: str) -> tuple[str, ...]:
    return tuple(f"{word[:n]}-" for n in (4, 5) if len(word) > n)


def _surroundings(parts: list[np.ndarray], size: int) -> np.ndarray:
    """How many different second numbers stand beside each first number."""
    table = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    new = np.ones(len(table), bool)
    new[1:] = (table[1:] != table[:-1]).any(1)
    return np.bincount(table[new, 0].astype(np.int64), minlength=size)


def telling_units(texts: Sequence[str], toxic: Sequence[int]) -> set[str]:
    """Words, and beginnings of other words, that tell toxic documents from the others.

    A unit counts once for each pair of neighbours it stands between, not for each document, so
    that the words of a text with many near copies do not pass for telling ones. Words that tell
    by themselves say nothing about their beginnings.
    """
    numbers: dict[str, int] = {"": 0}
    rows: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for text, y in zip(texts, toxic):
        own = [numbers.setdefault(w, len(numbers)) for w in TOKEN.findall(text.lower()) if w not in ENDS]
        ids = np.array([0, *own, 0], np.uint64)
        if own:
            rows[bool(y)].append(np.stack([ids[1:-1], (ids[:-2] << np.uint64(32)) | ids[2:]], 1))
    n1, n0 = sum(map(bool, toxic)), sum(not y for y in toxic)
    least = max(TOKEN_DOCUMENTS, TOKEN_SHARE * n1)

    def telling(clean: np.ndarray, bad: np.ndarray) -> np.ndarray:
        odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        return (bad >= least) & (odds >= TOKEN_ODDS)

    words = list(numbers)
    told = telling(*(_surroundings(p, len(words)) for p in rows))
    units: dict[str, int] = {}
    of = [[units.setdefault(u, len(units)) for u in beginnings(w)] for w in words]
    found = {w for w, t in zip(words, told) if t}
    if units:
        spread = []
        for parts in rows:
            out = []
            for n in range(2):
                first = np.array([u[n] if len(u) > n and not t else -1 for u, t in zip(of, told)])
                for table in parts:
                    unit = first[table[:, 0].astype(np.int64)]
                    keep = unit >= 0
                    out.append(np.stack([unit[keep].astype(np.uint64), table[keep, 1]], 1))
            spread.append(_surroundings(out, len(units)))
        found |= {u for u, t in zip(units, telling(*spread)) if t}
    return found


def fit(texts: Sequence[str], toxic: Sequence[int]) -> Model:
    """The field of ``texts`` with document labels.

    Labelled tokens come first: in a toxic document the words that tell such documents apart
    over the whole sample, everywhere else none. The field is fitted to those tags by Adam on at
    most ``PER_CLASS`` documents of each class, then the link from evidence to document score. A
    sample of one class only gives the score 0 or 1 to all.
    """
    toxic = [int(bool(y)) for y in toxic]
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), np.zeros((3, 2)), ((30.0 if toxic and toxic[0] else -30.0), 0.0))
    telling = telling_units(texts, toxic)
    seen = [0, 0]
    chosen = []
    for i, y in enumerate(toxic):
        if seen[y] < PER_CLASS:
            seen[y] += 1
            chosen.append(i)
    sample, labels = [texts[i] for i in chosen], np.array([toxic[i] for i in chosen])
    owner, chain, place, follows, words = chains([TOKEN.findall(t) for t in sample])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w.lower() for w in words))}
    at = np.fromiter((vocabulary[w.lower()] for w in words), np.int64, len(words))
    tag = np.fromiter((not telling.isdisjoint((w, *beginnings(w))) for w in vocabulary), bool, len(vocabulary))[at] & (labels[owner] == 1)
    hashed = [features(w) for w in vocabulary]
    rows = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
    columns = np.array([i for h in hashed for i in h], np.int64)
    before = np.full(len(tag), 2)
    before[1:] = np.where((place[1:] > 0) | follows[chain[1:]], tag[:-1].astype(int), 2)
    observed = np.zeros((3, 2))
    np.add.at(observed, (before, tag.astype(int)), 1)
    weights, trans = np.zeros(BUCKETS), np.zeros((3, 2))
    trans[:, 1] = -4.0
    state = [np.zeros(BUCKETS + 6), np.zeros(BUCKETS + 6)]
    n = len(labels)
    for step in range(1, STEPS + 1):
        p, expected = marginals(np.bincount(rows, weights[columns], len(hashed))[at], chain, place, trans, follows)
        error = np.bincount(at, p - tag, len(hashed))
        grad = np.concatenate([np.bincount(columns, error[rows], BUCKETS) / n + PENALTY * weights,
                               ((expected - observed) / n).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = RATE * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:BUCKETS]
        trans -= move[BUCKETS:].reshape(3, 2)
    model = Model(weights.astype(np.float32), trans, (0.0, 1.0))
    total, _ = model.evidence(sample)
    x, link = np.log(total + 1e-3), np.zeros(2)
    for _ in range(50):  # Newton steps of a logistic regression with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(link[0] + link[1] * x, -40, 40)))
        g = np.array([(p - labels).sum(), ((p - labels) * x).sum()]) + 0.1 * link
        v = p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.1 * np.eye(2)
        link -= np.linalg.solve(h, g)
    model.link = (float(link[0]), float(link[1]))
    return model


def toxicity(text: Column, shared) -> Column:
    """``struct<score, spans>`` of whole texts by the model in the broadcast ``shared``.

    Null and empty texts have no evidence and so the lowest score. Spans are code point offsets.
    """
    @F.pandas_udf(SCHEMA)
    def tag(texts: pd.Series) -> pd.DataFrame:
        key, model = shared.value
        model = resident("toxicity", "model", key, lambda: model)
        texts = texts.where(texts.notna(), None).tolist()
        scores, spans = [], []
        for lo in range(0, len(texts), 250):
            s, found = model.predict(texts[lo:lo + 250])
            scores.extend(s)
            spans.extend([{"start": a, "end": b, "probability": p} for a, b, p in x] for x in found)
        return pd.DataFrame({"score": scores, "spans": spans})

    return tag(text)
