"""Packing of documents into training windows by lexical retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .common import give_back

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: Documents and tokens after which a shard is closed. Both bound the memory of a task.
SHARD_DOCUMENTS, SHARD_TOKENS = 3000, 3_000_000
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: What a test holds the index against: terms an item is sought by, and the share of the items a term may stand in. No limit.
QUERY_TERMS, COMMON = float("inf"), 1.0
#: Share of the different items from which a term's weights are held as a dense row, and ids counted at once.
DENSE, PART = 1 / 8, 1 << 20


def _counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) < 4096:
        return np.unique(ids, return_counts=True)
    total = np.zeros(int(ids.max()) + 1, np.int64)
    for lo in range(0, len(ids), PART):
        some = np.bincount(ids[lo:lo + PART].astype(np.int64))
        total[:len(some)] += some
    found = np.flatnonzero(total)
    return found, total[found]


class Index:
    """Inverted BM25 index over the items of one shard; terms are token ids.

    Items with equal ids stand in it once, with their number, so that a large group of copies
    costs no more than one of them.
    """

    def __init__(self, items: list[np.ndarray]) -> None:
        n = len(items)
        numbers: dict[bytes, int] = {}
        self.group = np.array([numbers.setdefault(xxhash.xxh3_128_digest(np.ascontiguousarray(x)), len(numbers)) for x in items], np.int64)
        self.members = np.argsort(self.group, kind="stable")
        times = np.bincount(self.group, minlength=len(numbers))
        self.begin = np.concatenate([[0], np.cumsum(times)])
        different = [items[i] for i in self.members[self.begin[:-1]]]
        sizes = np.array([len(x) for x in different], np.int64)
        counted = [_counts(x) for x in different]
        term = np.concatenate([t for t, _ in counted]).astype(np.int64) if n else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counted]) if n else term
        owner = np.repeat(np.arange(len(different)), [len(t) for t, _ in counted])
        df = np.bincount(term, times[owner]) if len(term) else np.zeros(1)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max((sizes * times).sum() / max(n, 1), 1))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        # a term of one item leads to no other
        told = np.split(term, np.cumsum([len(t) for t, _ in counted])[:-1]) if n else []
        told = [t[df[t] > 1] for t in told]
        self.terms = [told[g] for g in self.group]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        postings = np.bincount(term, minlength=1)
        self.first = np.concatenate([[0], np.cumsum(postings)])
        common = np.flatnonzero(postings > DENSE * len(different))
        self.row = np.full(len(postings), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(different)), np.float32)
        at = self.row[term]
        self.dense[at[at >= 0], owner[at >= 0]] = weight[at >= 0]

    def neighbours(self, item: int) -> np.ndarray:
        """Items that share terms with ``item``, best first by BM25 over all its terms, itself included."""
        terms = self.terms[item]
        rows = self.row[terms]
        score = self.dense[rows[rows >= 0]].sum(axis=0).astype(float)
        spans = [slice(self.first[t], self.first[t + 1]) for t in terms[rows < 0]]
        if spans:
            found = np.concatenate([self.owner[s] for s in spans])
            score += np.bincount(found, np.concatenate([self.weight[s] for s in spans]), len(score))
        hit = np.flatnonzero(score)
        hit = hit[np.argsort(-score[hit], kind="stable")]
        sizes = self.begin[hit + 1] - self.begin[hit]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.members[np.repeat(self.begin[hit], sizes) + within]


def shard_pieces(documents: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of one shard, every window full but the last few.

    Whole windows are cut off the front of long documents. The rests are what is retrieved, by the
    terms of their whole documents: the first unused one is a seed, and its unused neighbours follow it into the window, best
    first; when they are used up, the next unused item is the seed. The item that crosses the end
    is cut there, and its rest and neighbours open the next window. What is left at last is cut to
    powers of two, which need no padding.
    """
    sequence = 0
    begin = []
    for d, ids in enumerate(documents):
        whole = len(ids) // window
        for k in range(whole):
            yield d, k * window, window, sequence, 0
            sequence += 1
        begin.append(whole * window)
    owners = [d for d, ids in enumerate(documents) if len(ids) > begin[d]]
    items = [documents[d][begin[d]:] for d in owners]
    index = Index([documents[d] for d in owners])
    left = sum(map(len, items))
    used = np.zeros(len(items), bool)
    turn = 0

    def following(i: int) -> Iterator[int]:
        near = index.neighbours(i)
        return iter(near[~used[near]].tolist())

    carry = None  # the item whose rest opens the next window, and where that rest begins
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        filled = 0
        near = following(carry[0]) if carry else iter(())
        while filled < size:
            if carry:
                (i, at), carry = carry, None
            else:
                i, at = next((x for x in near if not used[x]), None), 0
                if i is None:
                    while used[turn]:
                        turn += 1
                    i, near = turn, following(turn)
            used[i] = True
            take = min(len(items[i]) - at, size - filled)
            d = owners[i]
            yield d, begin[d] + at, take, sequence, filled
            filled += take
            if at + take < len(items[i]):
                carry = (i, at + take)
        left -= filled
        sequence += 1


def pack(documents: DataFrame, content: str, pattern: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """One row per piece of a document: its ids, cut and laid into windows of ``window`` tokens.

    A document is its BPE ids and ``end_id``; a null text is an empty one, so every row has at
    least one token. Shards are runs of input rows, closed at ``SHARD_DOCUMENTS`` documents or
    ``SHARD_TOKENS`` tokens; each has its own inverted index and is packed where it is read, so
    no text is shuffled and a lost task repeats only its own shards. A document longer than a
    shard is a shard of its own. Repeated rows are packed as often as they stand there.
    ``sequence_id`` numbers the windows: task number times 2^32 and a count within the task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = bpe.load(content, pattern)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list[int | None] = []
        arrays: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            nonlocal base
            rows = list(shard_pieces(arrays, window))
            d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
            out = pd.DataFrame({
                "doc_id": pd.array([ids[i] for i in d], dtype="Int64"), "start": start, "length": length,
                "ids_crc32": [zlib.crc32(arrays[i][s:s + n].tobytes()) for i, s, n in zip(d, start, length)],
                "doc_tokens": [len(arrays[i]) for i in d], "sequence_id": base + sequence, "offset": offset})
            base += int(sequence.max()) + 1
            ids.clear()
            arrays.clear()
            return out

        tokens = 0
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for key, text in zip(batch["doc_id"], texts):
                coded = coder.encode(text)
                coded.append(end_id)
                ids.append(None if pd.isna(key) else int(key))
                arrays.append(np.frombuffer(coded, np.uint32).astype("<u4", copy=False))
                tokens += len(coded)
                if len(arrays) >= SHARD_DOCUMENTS or tokens >= SHARD_TOKENS:
                    yield flush()
                    tokens = 0
        if arrays:
            yield flush()
        give_back()  # an index is far larger than what a worker needs otherwise

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)
