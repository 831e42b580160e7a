import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuscope.llm import bpe, packing
from corpuscope.llm.queries import QUERIES, byte_bpe

from .conftest import ROWS, SMALL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_and_counts_are_the_librarys(library):
    coder = bpe.load(*byte_bpe())
    rng = random.Random(5)
    parts = [*" \n\t\r\x0b\x85\xa0  ​\x1c'sAb12.!é你\U0001f600́", "<|endoftext|>", "  ", "\n\n", "'ll", " 's", "the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)] + [r[1] or "" for r in ROWS]
    assert [list(coder.encode(t)) for t in texts] == [ids_of(library, t) for t in texts]
    assert coder.count(texts) == [len(ids_of(library, t)) for t in texts]


@pytest.mark.parametrize("where", ["odd", "small"])
def test_token_counts(spark, library, odd, where):
    folder = odd if where == "odd" else SMALL
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((str(d), len((t or "").encode()), n := len(ids_of(library, t)), n > 1024) for d, t in texts)
    got = sorted((str(r[0]), *r[1:4]) for r in QUERIES["op7_token_counts"](spark, folder).collect())
    assert got == want


@pytest.mark.parametrize("where", ["odd", "small"])
def test_packing_holds_every_id_once(spark, library, odd, where):
    folder = odd if where == "odd" else SMALL
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op9_packing"](spark, folder).collect()
    want = sorted((str(d), len(ids_of(library, t)) + 1) for d, t in texts)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for length in windows.values():
        at = 0
        for offset, n in sorted(length):
            assert offset == at and n > 0
            at += n
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    got = [(str(d), r["doc_tokens"]) for d, rs in pieces.items() for r in rs if r["start"] == 0]
    assert sorted(got) == want
    by_id = {d: t for d, t in texts}
    for d, rs in pieces.items():
        ids = np.array([*ids_of(library, by_id[d]), 1], "<u4")
        for r in rs:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in rs) % len(ids) == 0


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 60, rng.integers(5, 80)).astype("<u4") for _ in range(40)]
    index = packing.Index(items)
    n, mean = len(items), np.mean([len(x) for x in items])
    df = {t: sum(t in x for x in items) for t in range(60)}
    def bm25(t, x):
        tf = int((x == t).sum())
        idf = np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
    for i in range(n):
        want = np.array([sum(bm25(t, x) for t in index.terms[i]) for x in items])
        got = index.neighbours(i)
        assert set(got) == set(np.flatnonzero(want))
        assert np.all(np.diff(want[got]) <= 1e-4)
        telling = sorted(((-round(float(np.float32(bm25(t, items[i]))), 4), t) for t in set(items[i].tolist())
                          if 1 < df[t] <= max(2, packing.COMMON * n)))
        assert len(index.terms[i]) == min(packing.QUERY_TERMS, len(telling))


def test_similar_documents_share_a_window():
    rng = np.random.default_rng(4)
    topics = [rng.integers(k * 100, k * 100 + 100, 400) for k in range(30)]
    documents = [rng.permutation(topics[i % 30])[:300].astype("<u4") for i in range(300)]
    at = defaultdict(set)
    for d, _, _, sequence, _ in packing.shard_pieces(documents, 2048):
        at[sequence].add(d % 30)
    assert np.mean([len(x) for x in at.values()]) < 3


def test_neighbours_by_all_terms_with_a_third_of_copies():
    rng = np.random.default_rng(8)
    copy = rng.integers(0, 300, 60).astype("<u4")
    items = [copy if i % 3 == 0 else rng.integers(0, 300, rng.integers(5, 80)).astype("<u4") for i in range(90)]
    index = packing.Index(items)
    mean = np.mean([len(x) for x in items])
    df = {t: sum(t in x for x in items) for t in range(300)}

    def bm25(t, x):
        tf = int((x == t).sum())
        return np.log1p((90 - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (
            tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))

    for i in range(0, 90, 5):
        want = np.array([sum(bm25(t, x) for t in set(items[i].tolist()) if df[t] > 1) for x in items])
        got = index.neighbours(i)
        assert sorted(got) == list(np.flatnonzero(want))
        assert np.all(np.diff(want[got]) <= 1e-4)
    assert set(range(0, 90, 3)) <= set(index.neighbours(0).tolist())


def test_the_rest_of_a_long_document_follows_its_front():
    topic = np.arange(64)
    documents = [np.concatenate([topic, np.arange(1000, 1020)])]
    documents += [np.arange(2000 + 30 * i, 2022 + 30 * i) for i in range(20)] + [topic[:20], topic[30:50]]
    documents = [d.astype("<u4") for d in documents]
    at = {d: s for d, start, _, s, offset in packing.shard_pieces(documents, 64) if d in (0, 21, 22)}
    assert at[0] == at[21] == at[22]
