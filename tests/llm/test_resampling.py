"""Importance resampling against its SQL and plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from checks import compare
from corpuscope.llm import resampling
from corpuscope.llm.queries import ORACLES, QUERIES

from .conftest import ROWS, SMALL


def test_pair_checksums_are_those_of_joined_texts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé你0", k=rng.choice([1, 2, 5, 20, 21, 22, 30, 200]))).encode() for _ in range(300)]
    a, b = (np.array([rng.randrange(300) for _ in range(2000)]) for _ in range(2))
    want = [zlib.crc32(words[i] + b" " + words[j]) for i, j in zip(a, b)]
    assert resampling.pair_checksums(words, a, b).tolist() == want


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def test_features_of_odd_texts():
    texts = [None, "", "  ", "a", "A-B_c", "ÄÖ é", "x" * 70000 + " y", "a\x00b\x7fc", "a b a b"]
    n_words, owner, buckets = resampling.features(pa.array(texts))
    for i, t in enumerate(texts):
        words, want = bag(t)
        assert n_words[i] == len(words) and sorted(buckets[owner == i].tolist()) == sorted(want)


def test_query_over_odd_rows_by_brute_force(spark, odd):
    docs = [(d, *bag(t)) for d, t, *_ in ROWS]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, _, f in docs:
        np.add.at(s, f, 1)
    for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect():
        np.add.at(t, bag(r["text"])[1], 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10000) / ((x + 1) * (t.sum() + 10000)))) for x, y in zip(s, t)]
    want = []
    for d, words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0, w[1]))
    for i, w in enumerate(able[:25 * len(able) // 100]):
        w[4] = i + 1
    got = [list(r) for r in QUERIES["op11_resampling"](spark, odd).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(str, got)) == sorted(str(w[:5]) for w in want)


def test_equal_rows_are_numbered_apart(spark):
    text = "word " * 30
    docs = spark.createDataFrame([(1, text)] * 400 + [(i, text + str(i)) for i in range(2, 402)], "doc_id long, text string").repartition(7)
    rows = resampling.resample(docs, docs).collect()
    assert len(rows) == 800 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 201))
    drawn = [r for r in rows if r["rank"]]
    assert sorted(drawn, key=lambda r: r["rank"]) == sorted(drawn, key=lambda r: (-r["score"], r["doc_id"], r["rank"]))


def test_query_equals_sql(spark):
    assert compare.compare(spark, SMALL, "op11", QUERIES["op11_resampling"], ORACLES["op11_resampling"]) == ""
