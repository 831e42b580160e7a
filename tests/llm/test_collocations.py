"""Phrase collocations against SQL and plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks import compare
from corpuscope.llm import collocations
from corpuscope.llm.queries import ORACLES, QUERIES

from .conftest import SMALL


def brute(rows, least, longest=5, told=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        inside = any(l == lang and len(w) > len(words) and b >= a and any(w[i:i + len(words)] == words for i in range(len(w)))
                     for (l, w), b in candidates.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:told]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("side, block, held", [(1 << 11, 1 << 20, 1 << 21), (4, 300, 20), (1, 50, 4)])
def test_phrases_by_brute_force(spark, monkeypatch, side, block, held):
    """Tiles, blocks and lists of all sizes: dense cells, coordinates, and both handed on early."""
    for name, value in (("SIDE", side), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(side)
    words = ["the", "The", "of", "a", "a", "b'c", "ü", "Ü", "你", "x y", "0", "-", "\x00"]
    fixed = ["in the middle of nowhere", "a a a a", "now and then", "\tnow  and\tthen "]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(
        rng.choice([*(w + " " for w in words), *(p + " " for p in fixed), ". ", ",", "\n", "\r\n", "\x0b", " "]) for _ in range(rng.randint(0, 60))))
        for _ in range(300)] + [("en", None), (None, ""), ("fr", "one word")] + [("en", "now and then " * 40)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, least=9).collect()]
    assert sorted(got) == brute(rows, 9)


def test_first_of_each_language(spark):
    rows = [("en", f"p{i} q{i}. " * (5 + i)) for i in range(12)] + [("de", "x y. " * 7)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in collocations.collocations(docs, least=5, told=4).collect()]
    assert sorted(got) == brute(rows, 5, told=4) and len(got) == 5


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([([big, big - 1], [big + 5, big - 1])], "first array<long>, last array<long>")
    from pyspark.sql import functions as F
    n = 9_000_000_000_000_000
    cut = row.select(collocations._weakest_cut(F.lit(n)).alias("c")).select("c.*").first()
    assert tuple(cut) == (1000 * (big - 1) * n // (big * (big + 5)), 1, big, big + 5)


def test_tiles_count_every_pair():
    rng = np.random.default_rng(1)
    tiles, want = collocations.Tiles(), Counter()
    for high in (10, 5000, 1 << 20, 1 << 40):
        ids = rng.integers(-1, high, 3000)
        tiles.add(*collocations._pairs(ids))
        want.update((a, b) for a, b in zip(ids.tolist(), ids[1:].tolist()) if a >= 0 and b >= 0)
    got = {(int(a), int(b)): int(n) for x in tiles.rest() for a, b, n in zip(*x)}
    assert got == want


def test_query_equals_sql(spark):
    assert compare.compare(spark, SMALL, "op13", QUERIES["op13_collocations"], ORACLES["op13_collocations"]) == ""


@pytest.mark.parametrize("side", [1, 3, 1 << 10])
def test_longer_phrases_of_a_block_by_brute_force(monkeypatch, side):
    monkeypatch.setattr(collocations, "SIDE", side)
    rng = np.random.default_rng(side)
    ids = np.where(rng.random(3000) < 0.1, -1, rng.integers(0, 7, 3000) ** 2 * 1_000_003)
    every = np.full(collocations.FILTER // 64, -1, "<i8")
    for size in (3, 4, 5):
        got = Counter()
        for words, n in collocations._phrases(ids, size, [every] * (size - 2)):
            got.update({tuple(w): int(c) for w, c in zip(words.tolist(), n)})
        windows = (tuple(ids[i:i + size].tolist()) for i in range(len(ids) - size + 1))
        assert got == Counter(w for w in windows if min(w) >= 0)
    none = np.zeros(collocations.FILTER // 64, "<i8")
    assert sum(n.sum() for _, n in collocations._phrases(ids, 3, [none])) == 0
    assert list(collocations._phrases(ids[:0], 4, [every, every]))[0][0].shape == (0, 4)


def test_the_filter_lets_frequent_phrases_through(spark):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 40, (500, 3))
    mask = collocations._filter(spark.createDataFrame([(x,) for x in ids.tolist()], "ids array<long>").repartition(3), 3)
    flat = ids.ravel()
    assert collocations._let_through(mask, collocations._spot(flat, np.arange(0, 1500, 3), 3)).all()
    other = rng.integers(0, 1 << 40, 3000)
    assert collocations._let_through(mask, collocations._spot(other, np.arange(0, 3000, 3), 3)).sum() < 5


def _entries(rows):
    """The entries ``book, lang, at, word, n`` of the books among rows of blocks, and all words the blocks' ids stand for."""
    books, blocks = {}, []
    for r in rows:
        if r["words"] is not None:
            books[r["book"]] = (r["lang"], r["words"], r["counts"])
        else:
            blocks.append((r["book"], np.frombuffer(r["ids"], "<i4")))
    text = Counter((books[b][0], books[b][1][i]) for b, ids in blocks for i in ids.tolist() if i >= 0)
    return [(b, lang, i, w, n) for b, (lang, words, counts) in books.items() for i, (w, n) in enumerate(zip(words, counts))], text


@pytest.mark.parametrize("block, book", [(20, 16), (20, 3), (1 << 20, 16)])
def test_blocks_of_a_task_share_a_dictionary(monkeypatch, block, book):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "BOOK", book)
    texts = [(("en", "de")[i % 2], f"the cat. a cat{i % 3}, the\n") for i in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array([c[k] for c in texts]) for k in (0, 1)], names=["lang", "text"])
    rows = [r for b in collocations._blocks(iter([batch, batch])) for r in b.to_pylist()]
    entries, text = _entries(rows)
    want = Counter((lang, w) for lang, t in texts * 2 for w in re.findall("[a-z0-9]+", t))
    assert text == want
    counted = Counter()
    for _, lang, _, w, n in entries:
        counted[lang, w] += n
    assert counted == want
    assert sum(r["words"] is None for r in rows) >= (60 if block == 20 else 2)
    # a book has an entry for a word however many blocks it has
    assert len(entries) <= len(want) * (sum(r["words"] is None for r in rows) // (2 * book) + 1)


def test_books_are_told_the_ranks_of_their_words():
    rng = random.Random(2)
    entries = [(book, lang, at, w, rng.randint(1, 9)) for book in (7, 1 << 32, 5) for lang in ("en", "de")
               for at, w in enumerate(rng.sample(["a", "b", "c", "d\x00", "", "en", "é"], 6))]
    entries = [(2 * b + (lang == "en"), lang, at, w, n) for b, lang, at, w, n in entries]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("book", "lang", "at", "word", "n"), e)) for e in entries[lo:lo + 5]])
               for lo in range(0, len(entries), 5)]
    rows = [r for b in collocations._ranked(iter(batches), 12) for r in b.to_pylist()]
    f = Counter()
    for _, lang, _, w, n in entries:
        f[lang, w] += n
    words = [r for r in rows if r["word"] is not None]
    assert [(r["lang"], r["word"], r["f"]) for r in words] == sorted(
        ((*k, n) for k, n in f.items() if n >= 12), key=lambda x: (-x[2], x[0], x[1]))
    assert [r["rank"] for r in words] == list(range(len(words))) and 0 < len(words) < len(f)
    rank = {(r["lang"], r["word"]): r["rank"] for r in words}
    told = {(r["book"], a): x for r in rows if r["word"] is None for a, x in zip(
        np.frombuffer(r["at"], "<i4").tolist(), np.frombuffer(r["ranks"], "<i8").tolist())}
    assert told == {(b, at): rank[lang, w] for b, lang, at, w, _ in entries if (lang, w) in rank}
    # one row a book, not one a word of each book
    assert sum(r["word"] is None for r in rows) == len({e[0] for e in entries})
    assert list(collocations._ranked(iter([]), 1)) == []


@pytest.mark.parametrize("held, most", [(1 << 20, 30), (40, 30 * 400), (1, 30 * 400)])
def test_a_task_adds_up_the_phrases_of_its_blocks(monkeypatch, held, most):
    monkeypatch.setattr(collocations, "HELD", held)
    rng = np.random.default_rng(5)
    found = []
    for _ in range(400):
        words = np.unique(rng.integers(0, 30, 12))
        found.append((np.stack([words, words * 7, words << 33], 1), rng.integers(1, 5, len(words))))
    found.insert(3, (np.zeros((0, 3), np.int64), np.zeros(0, np.int64)))
    want, got, rows = Counter(), Counter(), 0
    for words, n in found:
        want.update({tuple(w): c for w, c in zip(words.tolist(), n.tolist())})
    for words, n in collocations._summed(iter(found)):
        got.update({tuple(w): c for w, c in zip(words.tolist(), n.tolist())})
        rows += len(n)
    assert got == want and rows <= most
    assert list(collocations._summed(iter([]))) == []
