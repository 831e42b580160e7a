"""Near duplicates of texts and vectors against brute force."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from corpuscope.llm import minhash, vectors
from corpuscope.llm.components import components
from corpuscope.llm.queries import QUERIES, shared

from .conftest import SMALL


def joined(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (500, 501), (501, 500)]
    links += [(rng.randint(600, 700), rng.randint(600, 700)) for _ in range(60)]
    rng.shuffle(links)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    want = joined({n for a, b in links for n in (a, b)}, links)
    assert got == {n: want[n] for n in nodes}


def bags(texts):
    weights = minhash.Weights(len(texts), {})
    return [weights.bag(t) for t in texts]


def brute(rows):
    """Classes by comparing all pairs with plain dictionaries; all weights alike but for repeats."""
    def bag(t):
        words = t.split()
        out = {}
        for i in range(max(len(words) - 4, 1)):
            s = tuple(words[i:i + 5])
            out[s] = out.get(s, 0) + 1
        return out

    b = [bag(t) for _, t in rows]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            low = sum(min(n, b[j].get(s, 0)) for s, n in b[i].items())
            high = sum(b[i].values()) + sum(b[j].values()) - low
            if low / high >= 0.8:
                links.append((rows[i][0], rows[j][0]))
    return joined([r[0] for r in rows], links)


@pytest.mark.parametrize("paired", [48, 0])
def test_near_copies_by_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "LEADERS", 1 if paired == 0 else 4)
    rng = random.Random(9)
    rows = []
    for family in range(30):
        base = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 160))]
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, "two words") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, lambda m: shared(spark, m)).collect()}
    assert got == brute(rows)


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (7, text), (5, "another text of its own with more words than five"), (None, text), (None, text), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = minhash.drop_near_duplicates(docs, lambda m: shared(spark, m)).collect()
    assert sorted(map(str, left)) == sorted(map(str, spark.createDataFrame(
        [rows[0], rows[3], rows[4], rows[5], rows[6], rows[7]], docs.schema).collect()))


def test_word_hashes_tell_words_apart_wherever_they_stand():
    rng = random.Random(5)
    words = list({"".join(rng.choices("abé你0-", k=rng.randint(1, 90))) for _ in range(4000)})
    text = [rng.choice(words) for _ in range(9000)]
    seen: dict[int, str] = {}
    for lo, hi in ((0, 9000), (17, 18), (100, 7000)):
        some = text[lo:hi]
        hashes = minhash.word_hashes(" ".join(some).encode())
        assert len(hashes) == len(some)
        for w, h in zip(some, hashes.tolist()):
            assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(text))


def test_frequent_shingles_weigh_less(spark):
    shared_part = " ".join(f"s{i}" for i in range(12))
    texts = [f"{shared_part} " + " ".join(f"d{d}w{i}" for i in range(60)) for d in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    weights = minhash._heavy(docs)
    # those whose min-hash lies in the shared passage count once a task
    assert 28 <= weights.n <= 40 and len(weights.heavy) == 8 and set(weights.heavy.values()) == {weights.n}
    hashes, weight = weights.bag(texts[0])
    assert sorted(set(np.round(weight, 9))) == pytest.approx([math.log(2), math.log(11)])


@pytest.mark.parametrize("parts", [1, 200])
def test_frequencies_cover_all_documents_on_any_split(spark, parts):
    """A passage that makes up most of each document, beside a group of near copies."""
    shared_part = " ".join(f"s{i}" for i in range(30))
    rows = [f"{shared_part} " + " ".join(f"d{d}w{i}" for i in range(10)) for d in range(40)]
    rows += [" ".join(f"c{i}" for i in range(100)) + f" end{d}" for d in range(60)]
    rows += [" ".join(f"o{d}w{i}" for i in range(20)) for d in range(100)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(parts)
    weights = minhash._heavy(docs)
    passage = set(np.unique(minhash.shingles(shared_part)).tolist())
    # the near copies but those whose own words hold the min-hash count once
    assert 141 <= weights.n <= 145 and set(weights.heavy) == passage and set(weights.heavy.values()) == {40}


def test_similarities_of_blocks_are_those_of_pairs(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(40)]
    weights = minhash.Weights(100, {int(h): 50 for h in minhash.shingles(texts[0])[:4]})
    want = [[minhash.weighted_jaccard(weights.bag(a), weights.bag(b)) for b in texts[15:]] for a in texts[:15]]
    items = [weights.items(t) for t in texts]
    assert minhash.similarities(items[:15], items[15:]) == pytest.approx(np.array(want))


def test_near_copies_do_not_count_as_common_phrases(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = list(base) if i % 3 == 0 else [f"o{i}w{k}" for k in range(60)]
        if i % 3 == 0:
            for _ in range(2):
                words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(minhash._heavy(docs).heavy) < 20
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, lambda m: shared(spark, m)).collect()}
    assert all(got[i] == (0 if i % 3 == 0 else i) for i in range(300))


def mostly_copies(spark):
    """300 texts, the first 290 of them near copies of one."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [f"b{k}" for k in range(200)] if i < 290 else [f"o{i}w{k}" for k in range(60)]
        for _ in range(2 * (i < 290)):
            words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_near_copies_stay_together_where_nearly_all_are(spark):
    """Those whose own words hold the least hash are copies as well, so they make no common phrase either."""
    docs = mostly_copies(spark)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, lambda m: shared(spark, m)).collect()}
    assert got == {i: 0 if i < 290 else i for i in range(300)}


def test_the_pipeline_keeps_one_of_near_copies_where_nearly_all_are(spark):
    docs = mostly_copies(spark)
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in left) == [0, *range(290, 300)]


def test_groups_of_near_copies_count_once_however_many_share_a_least_hash(spark):
    """Twenty groups begin with one passage, and no group has a hundredth of the texts."""
    rng = random.Random(8)
    passage = [f"s{i}" for i in range(30)]
    rows = []
    for g in range(20):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(8):
            rows.append(" ".join(passage + base + [f"end{k}"]))
    rows += [" ".join(f"o{d}w{i}" for i in range(20)) for d in range(900)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    weights = minhash._heavy(docs)
    # the passage stands in 20 of 920 independent texts, though in 160 of 1,060
    assert (weights.n, weights.heavy) == (920, {})


def brute_weighed(rows):
    """Classes by plain dictionaries: frequencies over the first text of each class of equal weights, then links."""
    def bag(t):
        words = t.split()
        out = {}
        for i in range(max(len(words) - 4, 1)):
            s = tuple(words[i:i + 5])
            out[s] = out.get(s, 0) + 1
        return out

    b = [bag(t) for _, t in rows]

    def classes(weight):
        links = []
        for i in range(len(rows)):
            for j in range(i):
                low = sum(weight(s) * min(n, b[j].get(s, 0)) for s, n in b[i].items())
                high = sum(weight(s) * n for x in (b[i], b[j]) for s, n in x.items()) - low
                if low / high >= 0.8:
                    links.append((rows[i][0], rows[j][0]))
        return joined([r[0] for r in rows], links)

    alike = classes(lambda s: 1)
    independent = [x for x, (i, _) in zip(b, rows) if alike[i] == i]
    counts: dict[tuple, int] = {}
    for x in independent:
        for s in x:
            counts[s] = counts.get(s, 0) + 1
    n = len(independent)
    return alike, classes(lambda s: math.log1p(n / max(counts.get(s, 0), minhash.SHARE * n, 1)))


def test_a_common_passage_counts_less_in_both_directions(spark):
    """Texts that a passage alone makes alike come apart, and one that only lacks the passage joins its copy."""
    rng = random.Random(12)
    rows = []
    for d in range(60):
        passage = [f"s{i}" for i in range(150)]
        own = [f"d{d}w{i}" for i in range(rng.randint(20, 60))]
        rows.append(" ".join(passage + own))
        if d % 4 == 0:
            own[rng.randrange(len(own))] = f"x{d}"
            rows.append(" ".join(passage + own))
    for d in range(20):
        own = [f"e{d}w{i}" for i in range(100)]
        rows += [" ".join(own), " ".join(own + [f"s{i}" for i in range(10 + 3 * (d % 9))])]
    rows += [" ".join(f"o{d}w{i}" for i in range(30)) for d in range(60)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, lambda m: shared(spark, m)).collect()}
    alike, want = brute_weighed(rows)
    assert got == want and got != alike


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(4)
    sampler = minhash.Sampler(minhash.Weights(1000, {}))
    agree, true = [], []
    for _ in range(60):
        base = [f"w{rng.random()}" for _ in range(200)] + ["again and again and again " * rng.randint(1, 3)]
        other = list(base)
        for _ in range(6):
            other[rng.randrange(200)] = f"x{rng.random()}"
        pair = [sampler.weights.bag(" ".join(x)) for x in (base, other)]
        keys = sampler.bands(pair)
        agree.append((keys[0] == keys[1]).mean())
        true.append(minhash.weighted_jaccard(*pair) ** minhash.ROWS)
    assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.06)


def vector_truth(rows, threshold=0.93):
    links, counts = [], {r[0]: 0 for r in rows}
    ok = lambda v: bool(v) and all(e is not None and math.isfinite(e) for e in v) and any(v)
    sound = [(i, l, vectors.units(np.array([v]))[0]) for i, v, l in rows if l is not None and ok(v)]
    for a in range(len(sound)):
        for b in range(a):
            (i, l, x), (j, m, y) = sound[a], sound[b]
            if l == m and len(x) == len(y) and vectors.exact_cosine(x, y) >= threshold:
                links.append((i, j))
                counts[i] += 1
                counts[j] += 1
    root = joined([r[0] for r in rows], links)
    return {i: (counts[i], root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("block", [2048, 64, 16, 5])
def test_vectors_by_brute_force(spark, monkeypatch, block):
    """Blocks smaller than the labels' sizes, so that there are cells, guests and several blocks."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "ROW_S", 0)
    rng = np.random.default_rng(block)
    rows = []
    for family in range(25):
        base = rng.normal(size=6)
        for _ in range(int(rng.integers(1, 16))):
            noise = rng.choice([0.0, 0.1, 0.2, 0.3])
            rows.append((len(rows), (base + noise * rng.normal(size=6)).astype(np.float32).tolist(), int(family % 2)))
    rows += [(len(rows), rows[0][1], 0), (len(rows) + 1, [1.0] * 5, 0), (len(rows) + 2, [2.0] * 5, 0), (len(rows) + 3, [2.0] * 5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r[0]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    assert got == vector_truth(rows)


def test_more_cells_where_vectors_lie_in_clusters():
    rng = np.random.default_rng(1)
    even = vectors.units(rng.normal(size=(4000, 64)))
    clustered = vectors.units(rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 64)))
    half = math.sqrt(2 - 2 * 0.93) / 2
    assert len(vectors.cells(clustered, 1e6, half)) > len(vectors.cells(even, 1e4, half)) >= 2
    assert len(vectors.cells(even, 500, half)) == 1


def test_vector_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op10_vectors"](spark, SMALL).collect()}
    assert got == vector_truth(rows)


def test_awkward_vectors(spark, odd):
    rows = QUERIES["op10_vectors"](spark, odd).collect()
    by = {r["vec_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == 16
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[11] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14):
        assert by[i] == (0, i, True)
    assert by[None] == (0, None, False)


def test_a_border_of_two_cells_full_of_near_copies_is_compared_at_once():
    """Counting what meets in two cells takes no time per pair."""
    import time

    import pandas as pd
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    side = lambda home, guests: pd.DataFrame({
        "node": np.arange(1500) + 10_000 * home, "x": [(base + 0.01 * rng.normal(size=16)).astype("<f8").tobytes() for _ in range(1500)],
        "home": home, "guests": [guests] * 1500, "copies": 1})
    started = time.perf_counter()
    both = vectors.compare(side(5, [2]), side(2, [5]), 5, 0.93, "<f8")
    other = vectors.compare(side(5, []), side(2, [5]), 5, 0.93, "<f8")
    assert time.perf_counter() - started < 4
    assert both["links"].sum() == 0 and other["links"].sum() == 2 * 1500 * 1500
    assert len(both) == 2999
