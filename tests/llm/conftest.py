from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"

PROSE = ("this is a sentence about nothing at all, written for a test of whole texts with more than five words "
         "in which neither a line nor a run of words stands twice, so that the rules have no reason to drop it")


def copies(i: int) -> str:
    """A text of its own with hardly a shingle in common with others."""
    return " ".join(f"w{i}x{k}" for k in range(40))


ROWS = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, "en", "a", 0),
    (4, "", "de", None, 0), (None, "a text without an id and with letters", "en", None, None), (5, "  \n\t ", None, "b", 5),
    (6, "123 456 !!", "fr", "b", 9), (7, copies(7), "de", "b", 1), (8, copies(7) + " more", "de", "b", 1),
    (9, "x" * 30_000, "fr", "c", 1), (10, ("wort " * 30_000).strip(), "de", "c", 1), (11, "one two", "en", "c", 1),
    (12, "a <|endoftext|> b  \x0b <|im_start|> ▁ 你好 \U0001f600́", None, "c", 1), (13, PROSE.upper() + " scum", "en", "d", 1),
    *((100 + i, copies(100 + i) + " " + PROSE[: 20 + i], ("de", "en", "fr")[i % 3], "e", 1) for i in range(40)),
]


def write(spark, folder, empty: bool) -> str:
    """The tables the queries read, with awkward rows, or without any, and with columns that clash."""
    clash = {c: F.lit(1) for c in ("score", "kept", "lang_pred", "n_words", "found", "m", "row", "before", "span", "node", "ids", "rank", "n", "weight", "f")}
    labels = [(r[0], i % 3 > 0, i % 4 == 0) for i, r in enumerate(ROWS)] + [(1, None, None), (1, True, None), (999, True, True)]
    labels = [(d, None if q is None else int(q), None if t is None else int(t)) for d, q, t in labels]
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] \\ <\\/s> <|im_end|>\n"),
             (1, 2, "assistant", "again"), (1, 2, "assistant", "again"), (1, None, None, "late"), (None, 0, "user", "no conversation"),
             (2, 0, "user\nx\\n", ""), (3, 5, "assistant", "word " * 4000), (4, 0, "assistant", ""),
             *((5, i, ("user", "assistant")[i % 2], f"turn {i} " + "text " * (i % 70)) for i in range(700))]
    v = [0.6, 0.8, 0.0]
    vectors = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
               (8, [0.6, None, 0.8], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (None, v, 1),
               (11, [1.2, 1.6, 0.1], 1), (12, [0.6, 0.8], 1), (13, [3e38, 4e38 / 10, 0.0], 1), (14, [0.0, 0.0, 1.0], 1)]
    target = [(1, PROSE), (2, None), (3, ""), (4, "one two three one two")]
    for name, rows, schema in (("documents", ROWS, DOCUMENTS), ("labels", labels, LABELS), ("benchmark", target, "item_id long, text string"),
                               ("conversations", turns, TURNS), ("embeddings", vectors, VECTORS)):
        df = spark.createDataFrame([] if empty else rows, schema)
        new = {c: x for c, x in clash.items() if c not in df.columns}
        df.withColumns(new).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), empty=False)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), empty=True)
