import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from corpuscope.llm import pieces
from corpuscope.llm.queries import QUERIES, shared

from .conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library's own search, over the same pieces and log probabilities."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.piece in vocabulary.scores:
            p.score = vocabulary.scores[p.piece]
    return SentencePieceProcessor(model_proto=model.SerializeToString())


def best(vocabulary, text):
    """The score of the best path by a plain search over the whole text."""
    top = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - vocabulary.longest), end):
            s = vocabulary.scores.get(text[begin:end], vocabulary.unknown if begin == end - 1 else None)
            if s is not None:
                top[end] = max(top[end], top[begin] + s)
    return top[-1]


def cost(vocabulary, ids):
    """The score of ids; a run of byte pieces is as many unknown characters as it decodes to."""
    total, raw, names = 0.0, b"", {i: p for p, i in vocabulary.ids.items()}
    for i in [*ids, None]:
        if i is not None and i in vocabulary.byte_ids:
            raw += bytes([i - vocabulary.byte_ids[0]])
            continue
        total += vocabulary.unknown * len(raw.decode())
        raw = b""
        if i is not None:
            total += vocabulary.scores[names[i]]
    return total


def texts():
    rng = random.Random(2)
    letters = [*"  abcdeinorst\n.é你\U0001f600", "the ", "tion", "   "]
    return ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(600)]


def test_best_path_and_round_trip(vocabulary):
    for t in texts():
        ids = vocabulary.encode(t)
        assert vocabulary.decode(ids) == t
        marked = "▁" + t.replace(" ", "▁")
        assert cost(vocabulary, ids) == pytest.approx(best(vocabulary, marked))


def one_by_one(vocabulary, text):
    return [i for p in vocabulary._stretches("▁" + text.replace(" ", "▁")) for run in vocabulary.search(p) for i in run]


def test_many_side_by_side_equal_one_by_one(vocabulary):
    rng = random.Random(7)
    long = ["".join(rng.choices("abcdeinorst.é你▁\U0001f600thetion", k=k)) for k in (15, 16, 17, 31, 33, 64, 100, 255, 256, 257, 700)]
    every = texts() + long
    together = vocabulary.encode_all(every)
    for t, ids in zip(every, together):
        assert ids.tolist() == one_by_one(vocabulary, t)


@pytest.mark.parametrize("memory", [0, 3, 40])
def test_forgotten_stretches_are_searched_again(vocabulary, monkeypatch, memory):
    monkeypatch.setattr(pieces, "MEMORY", memory)
    every = texts()[:200]
    for lo in range(0, 200, 20):
        for t, ids in zip(every[lo:lo + 20], vocabulary.encode_all(every[lo:lo + 20])):
            assert ids.tolist() == one_by_one(vocabulary, t)
    assert len(vocabulary._young) + len(vocabulary._old) < 5000


def test_a_path_that_spells_something_else_is_searched_by_pieces(vocabulary, monkeypatch):
    """As if a hash had met another text's: the path is checked against the text."""
    right = one_by_one(vocabulary, "some text here")
    wrong = vocabulary.ids["▁the"]
    monkeypatch.setattr(vocabulary, "_search_many", lambda xs: (pieces.np.array([wrong] * len(xs)), pieces.np.ones(len(xs), int)))
    vocabulary._young.clear(), vocabulary._old.clear()
    assert vocabulary.encode("some text here") == right
    vocabulary._young.clear()


def test_the_window_commits_before_the_end(vocabulary):
    text = "▁" + "thequickbrownfoxjumps" * 200
    runs = list(vocabulary.search(text))
    assert len(runs) > 20
    assert cost(vocabulary, [i for r in runs for i in r]) == pytest.approx(best(vocabulary, text))


def test_ordinary_text_is_committed_as_it_goes(vocabulary, spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(20).collect()
    for r in rows:
        text = "▁" + r["text"].replace(" ", "▁")
        runs = list(vocabulary.search(text))
        # nothing waits much longer than the window and a look
        assert max(map(len, runs)) <= 2 * pieces.LOOK + vocabulary.longest and len(runs) >= len(text) // 50


def test_the_librarys_ids(vocabulary, library):
    different = sum(vocabulary.encode(t) != library.encode(t) for t in texts())
    assert different <= 12  # ties in the score and single precision of the library


def test_query_decodes_to_the_texts(spark):
    rows = QUERIES["op1_sentencepiece"](spark, SMALL).collect()
    assert all(r["decodes_to_text"] and r["n_ids"] == len(r["ids"]) for r in rows)


def test_a_text_is_encoded_once(spark, tmp_path):
    texts = ["", None, "two words", "two words", "ünïcode 你好 \U0001f600  x", "▁ in it"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op1_sentencepiece"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("run(") == 1
    vocabulary = shared(spark, pieces.Vocabulary.read(PATH))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = pieces.encode(F.col("text"), vocabulary)
    want = docs.select("doc_id", ids, F.size(ids).cast("long"), pieces.decode(ids, vocabulary) == F.coalesce("text", F.lit("")))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, want.collect())))
