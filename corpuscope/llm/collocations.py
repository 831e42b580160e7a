"""Phrase collocations: contiguous phrases counted by direct-address tiles of ranked ids, level by level.

Frequent words are numbered by frequency. A pair of neighbouring ids is a cell of a square that is cut
into tiles: the tile of the most frequent ids is counted densely by ``bincount``, the others, which
are mostly empty, as sorted coordinates. For longer phrases the frequent pairs of a block of text are
numbered by frequency again, and two that overlap in all but a word at each end are a pair of the next
level; so it goes on to the longest phrases.

Texts are read once, into blocks of word numbers; a task's blocks share a dictionary, a book. The entries of
all books are dealt out by word once. Where a word's entries meet, they are added up, the word gets its id,
and each book is told the ids of its words as two arrays, so no vocabulary is broadcast or held whole by
a task. Which phrases of a block may be frequent is told by a filter of fixed size; one that it lets
through by mistake is counted and then falls short like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.operators.ranking import top_k_per_group

from .common import Kept, give_back

#: Words of the longest phrase, occurrences from which a phrase is a candidate, percent of a phrase's
#: occurrences that a longer one must reach to replace it, phrases told per language.
LONGEST, LEAST, INSIDE, TOLD = 5, 100, 100, 2000
UNKNOWN = "und"
#: Words of a block and different ones of a book, blocks of a book, and entries of books that meet in a task on average.
BLOCK, BOOK, ENTRIES = 1 << 20, 16, 1 << 20
#: Ids on a side of the dense tile, and sparse cells a task holds before it hands them on.
SIDE, HELD = 1 << 10, 1 << 20
#: Bits of the filter that phrases which cannot be frequent are dropped by, whatever the corpus: 8 MB.
FILTER = 1 << 26
#: Lower-cased letters; piece ends become line breaks, blanks become spaces.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else 10 if i in b".,;:!?\n\v\f\r" else 32 if i == 9 else i for i in range(256))

_U = np.uint64
BLOCKS = "book long, lang string, words array<string>, counts array<long>, ids binary"
RANKED = "lang string, word string, f long, part int, rank long, book long, at binary, ranks binary"


class _Dictionary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word numbers of many texts of one language at a time, -1 at the end of a piece; after a book's blocks its words."""
    schema = pa.schema([("book", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
                        ("ids", pa.binary())])
    held: dict[str, tuple[_Dictionary, list[np.ndarray]]] = {}
    counts: dict[str, np.ndarray] = {}
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    book, size, blocks = task << 32, 0, 0

    def row(number: int, lang: str, words: list | None, n: list | None, ids: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, lang, words, n, ids), schema)], schema=schema)

    def numbers(first: int) -> Iterator[pa.RecordBatch]:
        for at, (lang, (known, parts)) in enumerate(held.items()):
            if parts:
                ids = np.concatenate(parts)
                n = np.bincount(ids + 1, minlength=len(known))[1:]  # the first stands for piece ends
                n[:len(counts.get(lang, ()))] += counts.get(lang, 0)
                counts[lang] = n
                parts.clear()
                yield row(first + at, lang, None, None, ids.astype("<i4").tobytes())

    def words(first: int) -> Iterator[pa.RecordBatch]:
        for at, (lang, (known, _)) in enumerate(held.items()):
            yield row(first + at, lang, [w.decode() for w in list(known)[1:]], counts[lang].tolist(), None)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                found = text.encode().translate(_FOLD).replace(b"\n", b" . ").split()
                if lang not in held:
                    held[lang] = _Dictionary({b".": 0}), []
                known, parts = held[lang]
                parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)) - 1)
                parts.append(np.full(1, -1, np.int32))
                size += len(found)
                if size >= BLOCK:
                    yield from numbers(book)
                    size, blocks = 0, blocks + 1
                    if blocks == BOOK or sum(len(k) for k, _ in held.values()) >= BLOCK:
                        yield from words(book)
                        book, blocks = book + len(held), 0
                        held.clear()
                        counts.clear()
    yield from numbers(book)
    yield from words(book)
    held.clear()
    give_back()  # a book is far larger than what a worker needs otherwise


def _ranked(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From all entries ``book, lang, at, word, n`` of some words: the words of at least ``least`` occurrences, ranked among
    themselves by falling frequency, and for each book where its words have which rank."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()),
                        ("book", pa.int64()), ("at", pa.binary()), ("ranks", pa.binary())])
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    batches = list(batches)
    if not batches:
        return
    entries = pa.Table.from_batches(batches).combine_chunks()
    del batches
    langs, words = (entries[c].combine_chunks().dictionary_encode() for c in ("lang", "word"))
    cell = langs.indices.to_numpy().astype(np.int64) * max(len(words.dictionary), 1) + words.indices.to_numpy()
    cells, one, of = np.unique(cell, return_index=True, return_inverse=True)
    f = np.zeros(len(cells), np.int64)
    np.add.at(f, of, entries["n"].to_numpy())
    met = np.flatnonzero(f >= least)
    lang, word = (c.take(pa.array(one[met])).to_pylist() for c in (langs, words))
    order = sorted(range(len(met)), key=lambda i: (-f[met[i]], lang[i], word[i]))  # the same in every attempt
    for lo in range(0, len(order), 1 << 14):
        some = order[lo:lo + (1 << 14)]
        n = len(some)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang[i] for i in some], pa.string()), pa.array([word[i] for i in some], pa.string()), pa.array(f[met[some]]),
            pa.array(np.full(n, part, np.int32)), pa.array(np.arange(lo, lo + n)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
            pa.nulls(n, pa.binary())], schema=schema)
    rank = np.full(len(cells), -1, np.int64)
    rank[met[order]] = np.arange(len(order))
    rank = rank[of]
    known = np.flatnonzero(rank >= 0)
    book, at = (entries[c].to_numpy()[known] for c in ("book", "at"))
    by = np.lexsort((at, book))
    books, first = np.unique(book[by], return_index=True)
    for number, some in zip(books.tolist(), np.split(by, first[1:]) if len(books) else []):
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()),
            pa.array([number], pa.int64()), pa.array([at[some].astype("<i4").tobytes()]), pa.array([rank[known][some].astype("<i8").tobytes()])],
            schema=schema)


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring ids, both known."""
    a, b = ids[:-1], ids[1:]
    both = (a >= 0) & (b >= 0)
    return a[both], b[both]


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order and where each begins among the sorted ones; with the order."""
    if len(a) and max(int(a.max()), int(b.max())) < 1 << 31:
        cell = (a << 32) | b
        order = np.argsort(cell)
        cell = cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    else:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(a) else np.zeros(0, np.int64)
    return order[first], first, order


class Tiles:
    """Counts of pairs of ids: one dense tile of the smallest ids, sorted coordinates elsewhere."""

    def __init__(self) -> None:
        self.dense = np.zeros(SIDE * SIDE, np.int64)
        self.sparse: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        inner = (a < SIDE) & (b < SIDE)
        if inner.any():
            self.dense += np.bincount(a[inner] * SIDE + b[inner], minlength=SIDE * SIDE)
        a, b = a[~inner], b[~inner]
        if len(a):
            at, first, _ = _runs(a, b)
            self.sparse.append((a[at], b[at], np.diff(np.append(first, len(a)))))
            self.held += len(at)

    def merge(self) -> None:
        """All coordinates sorted into one list, equal ones added up."""
        a, b, n = (np.concatenate(c) for c in zip(*self.sparse))
        at, first, order = _runs(a, b)
        self.sparse = [(a[at], b[at], np.add.reduceat(n[order], first))]
        self.held = len(at)

    def hand_on(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.sparse:
            self.merge()
            yield self.sparse[0]
        self.sparse, self.held = [], 0

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cell = np.flatnonzero(self.dense)
        yield cell // SIDE, cell % SIDE, self.dense[cell]
        yield from self.hand_on()


def _spot(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The place in the filter of the phrases of ``size`` ids that begin at the places ``at``."""
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = (h ^ ids[at + j].astype(np.uint64)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return ((h * _U(0xBF58476D1CE4E5B9)) >> _U(32)).astype(np.int64) % FILTER


def _filter(frequent: DataFrame, size: int) -> np.ndarray:
    """Which places of the filter hold a frequent phrase, as ``FILTER`` packed bits."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(FILTER, bool)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            met[_spot(ids, np.arange(0, len(ids), size), size)] = True
        words = np.packbits(met).view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], names=["at", "w"])

    out = np.zeros(FILTER // 64, "<i8")
    found = frequent.select("ids").mapInArrow(bits, "at long, w long").groupBy("at").agg(F.bit_or("w").alias("w")).toPandas()
    out[found["at"].to_numpy(np.int64)] = found["w"].to_numpy(np.int64)
    return out


def _let_through(mask: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """The bits of packed ``mask`` at the places ``spot``."""
    return (mask.view(np.uint8)[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1


def _ranked_units(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pairs by falling frequency, and where each number is met first."""
    at, first, order = _runs(a, b)
    n = np.diff(np.append(first, len(a)))
    rank = np.empty(len(at), np.int64)
    by = np.argsort(-n, kind="stable")
    rank[by] = np.arange(len(at))
    unit = np.empty(len(a), np.int64)
    unit[order] = np.repeat(rank, n)
    return unit, at[by]


def _phrases(ids: np.ndarray, size: int, masks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word ids of the phrases of three words or more whose parts may all be frequent, with their counts.

    ``masks`` are the filters of the phrases of two to ``size - 1`` words. Pairs that pass are numbered by
    frequency within the block; then neighbours among the numbers are the pairs that are looked at next.
    """
    at = np.flatnonzero(ids >= 0)
    unit, spots = ids[at], at
    for length, mask in enumerate(masks, 2):
        beside = np.flatnonzero(np.diff(at) == 1)
        beside = beside[_let_through(mask, _spot(ids, at[beside], length))]
        unit, first = _ranked_units(unit[beside], unit[beside + 1])
        at = at[beside]
        spots = at[first]
    beside = np.flatnonzero(np.diff(at) == 1)
    tiles = Tiles()
    tiles.add(unit[beside], unit[beside + 1])
    for a, b, n in tiles.rest():
        yield np.concatenate([ids[spots[a][:, None] + np.arange(size - 1)], ids[spots[b] + size - 2][:, None]], 1), n


def _summed(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The phrases of many blocks with equal ones added up, as far as ``HELD`` of them reach."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        words, n = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort(words.T[::-1])
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
        held[:] = [(words[first], np.add.reduceat(n[order], first))]

    size = 0
    for words, n in found:
        if len(n):
            held.append((words, n))
            size += len(n)
        if size >= HELD:
            merge()
            size = len(held[0][1])
            if size >= HELD // 2:
                yield held.pop()
                size = 0
    if held:
        merge()
        yield held.pop()


def _count(level: DataFrame, size: int, masks: list) -> DataFrame:
    """``ids, n``: how often each phrase of ``size`` words occurs, added up over parts of the table.

    Frequent phrases are all there with whole counts; of others only those that pass the filters.
    """
    names = [f"w{i}" for i in range(size)]

    def rows(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(n), 1 << 16):
            some = words[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(some[:, i])) for i in range(size)),
                                              pa.array(n[lo:lo + (1 << 16)])], names=[*names, "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for batch in batches:
            for ids in _ids_of(batch):
                tiles.add(*_pairs(ids))
                if tiles.held >= HELD:
                    tiles.merge()
                    if tiles.held >= HELD // 2:
                        for a, b, n in tiles.hand_on():
                            yield from rows(np.stack([a, b], 1), n)
        for a, b, n in tiles.rest():
            yield from rows(np.stack([a, b], 1), n)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [m.value for m in masks]
        for words, n in _summed(found for batch in batches for ids in _ids_of(batch) for found in _phrases(ids, size, told)):
            yield from rows(words, n)

    counted = level.select("wide", "ids").mapInArrow(longer if masks else pairs, ", ".join(f"{c} long" for c in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("f")).select(F.array(*names).alias("ids"), "f")


def _frequent_words(kept: Kept, blocks: DataFrame, size: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, word, f, id`` of the frequent words, and ``book, at, ranks, part, parts``: which numbers of a book have
    which rank in which part.

    An id counts the ranks of the parts in turn: the first words of all parts, then the second ones, so the most
    frequent words have the smallest ids. The books have ``size`` entries, which tells how many parts there must be.
    """
    entries = blocks.where(F.col("words").isNotNull()).select("book", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    dealt = entries.select("book", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    least_parts = size // ENTRIES
    many = least_parts > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(*([least_parts] if many else []), "lang", "word")
    ranked = kept.write(dealt.mapInArrow(lambda batches: _ranked(batches, least), RANKED))
    parts = (ranked.agg(F.max("part")).first()[0] or 0) + 1
    words = ranked.where(F.col("word").isNotNull()).select("lang", "word", "f", (F.col("rank") * parts + F.col("part")).alias("id"))
    return words, ranked.where(F.col("book").isNotNull()).select("book", "at", "ranks", "part", F.lit(parts).cast("long").alias("parts"))


def _level_ids(blocks: DataFrame, met: DataFrame) -> DataFrame:
    """``block, wide, ids`` with the ids of the frequent words in place of the books' own numbers, other words left as gaps."""
    def rename(key: tuple, blocks: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        of = [(np.frombuffer(at, "<i4"), np.frombuffer(ranks, "<i8") * parts + part) for at, ranks, part, parts in zip(
            met["at"], met["ranks"], met["part"], met["parts"])]
        raws = [np.frombuffer(raw, "<i4") for raw in blocks["ids"]]
        highest = max([*(int(raw.max(initial=-1)) for raw in raws), *(int(at.max()) for at, _ in of)], default=-1)
        new = np.full(highest + 2, -1, np.int64)  # the last place stands for -1
        for at, ids in of:
            new[at] = ids
        return pd.concat([_dense(key[0], new[raw]) for raw in raws] or [_dense(key[0], np.zeros(0, np.int64))])

    ids = blocks.where(F.col("ids").isNotNull()).select("book", "ids")
    return ids.groupBy("book").cogroup(met.groupBy("book")).applyInPandas(rename, "block long, wide boolean, ids binary")


def _dense(block: int, ids: np.ndarray) -> pd.DataFrame:
    """A row of a block's ids with a single gap between runs, in four bytes each if they fit; none if there are no ids."""
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return pd.DataFrame({"block": [], "wide": [], "ids": []})
    apart = np.flatnonzero(np.diff(at) > 1) + 1
    out = np.insert(ids[at], apart, -1)
    wide = bool(out.max() >= 1 << 31)
    return pd.DataFrame({"block": [block], "wide": [wide], "ids": [out.astype("<i8" if wide else "<i4").tobytes()]})


def _ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each of the blocks in a batch."""
    for wide, raw in zip(batch.column("wide").to_pylist(), batch.column("ids")):
        yield np.frombuffer(raw.as_buffer(), "<i8" if wide else "<i4").astype(np.int64)


def _longer(frequent: DataFrame, phrases: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words: ``ids, lang, phrase, first, last``, from those of a word less.

    ``first`` holds the frequencies of a phrase's first words, from one to all of them, ``last`` those of its last words.
    """
    begin = phrases.select(F.col("ids").alias("a"), "lang", "phrase", "first")
    end = phrases.select(F.col("ids").alias("b"), F.substring_index("phrase", " ", -1).alias("word"), "last")
    cut = frequent.select("ids", "f", F.slice("ids", 1, size - 1).alias("a"), F.slice("ids", 2, size - 1).alias("b"))
    return cut.join(begin, "a").join(end, "b").select(
        "ids", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("first", F.array("f")).alias("first"),
        F.concat("last", F.array("f")).alias("last"))


def _weakest_cut(n: Column) -> Column:
    """The cut with the lowest score (the first among equals) as ``struct<score, k, l, r>``, in exact arithmetic.

    ``l`` and ``r`` are the frequencies of the first k and of the other words; whole numbers of 38 digits hold all products.
    """
    size = F.size("first")
    wide = lambda c: c.cast("decimal(19,0)")
    above = wide(F.lit(1000)) * wide(F.element_at("first", -1)) * wide(n)

    def cut(k: Column) -> Column:
        left, right = F.element_at("first", k), F.element_at("last", size - k)
        return F.struct(F.call_function("div", above, wide(left) * wide(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, told: int = TOLD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``told`` phrases of each language.

    Words are runs without space and tab in pieces that end at ``. , ; : ! ?`` and line breaks; A to Z
    are lower-cased. ``a`` counts the places at which a phrase of 2 to ``longest`` words begins, ``l`` and
    ``r`` those of the two parts of its weakest cut, ``n`` the words of the language. Phrases in fewer than
    ``least`` places, and those inside a longer one as frequent as themselves, are left out. A higher
    score goes first, then a higher ``a``, then the phrase in the order of its bytes.

    A null ``lang`` is ``und``, a null text is empty; equal rows count each. No documents give no rows.
    """
    kept = Kept(documents.sparkSession, "collocations")
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = kept.write(rows.mapInArrow(_blocks, BLOCKS))
    totals = kept.write(blocks.where(F.col("words").isNotNull()).select(
        "lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n"), F.size("counts").cast("long").alias("size")).groupBy(
            "lang").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    words, met = _frequent_words(kept, blocks, totals.agg(F.sum("size")).first()[0] or 0, least)
    phrases = words.select(F.array("id").alias("ids"), "lang", F.col("word").alias("phrase"), F.array("f").alias("first"), F.array("f").alias("last"))
    level = kept.write(_level_ids(blocks, met))
    kept.drop(blocks)
    found, masks = [], []
    for size in range(2, longest + 1):
        frequent = kept.write(_count(level, size, masks).where(F.col("f") >= least))
        phrases = kept.write(_longer(frequent, phrases, size))
        found.append(phrases)
        if size < longest:
            masks.append(documents.sparkSession.sparkContext.broadcast(_filter(frequent, size)))
    kept.drop(level)
    whole = lambda c: F.element_at(c, -1)
    candidates = []
    for shorter, longer in zip(found, [*found[1:], None]):
        if longer is not None:
            # a longer phrase has all shorter ones between them as candidates too, so the next size tells
            parts = [longer.where(100 * whole("first") >= INSIDE * F.element_at(c, -2)).select(F.slice("ids", begin, F.size("ids") - 1).alias("ids"))
                     for c, begin in (("first", 1), ("last", 2))]
            shorter = shorter.join(parts[0].unionByName(parts[1]).distinct(), "ids", "left_anti")
        candidates.append(shorter.select("lang", "phrase", "first", "last"))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionByName(more)
    scored = every.join(totals.select("lang", "n"), "lang").withColumn("cut", _weakest_cut(F.col("n"))).select(
        "lang", "phrase", whole("first").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_k_per_group(scored, ["lang"], order, told, spread=["phrase"])
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
