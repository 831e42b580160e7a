import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscope.llm import chat
from corpuscope.llm.queries import CONTROL_TEXT, QUERIES, byte_bpe

from .conftest import SMALL


@pytest.mark.parametrize("where", ["odd", "small"])
def test_what_is_read_back(spark, odd, where):
    folder = odd if where == "odd" else SMALL
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
    by[-1] = [(False, 0, "user", CONTROL_TEXT), (False, 1, "assistant", CONTROL_TEXT)]
    want = {}
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, _, role, t in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(),
                      len(learned), hashlib.sha256(learned.encode()).hexdigest())
    got = {r["conv_id"]: tuple(r)[1:5] for r in QUERIES["op8_chat"](spark, folder).collect()}
    assert got == want


def test_windows_keep_the_system_turn_and_limited_history(spark, odd):
    turns = spark.read.parquet(f"{odd}/conversations.parquet")
    long = turns.where("conv_id = 5").unionByName(spark.createDataFrame(
        [(5, -1, "system", "always here")], "conv_id long, turn long, role string, text string"), allowMissingColumns=True)
    rows = sorted(chat.windows(long, *byte_bpe()).collect(), key=lambda r: r["window_no"])
    assert len(rows) > 10
    last = None
    for r in rows:
        parsed = chat.parse(r["text"])
        assert parsed[0] == ("system", "always here")
        assert r["n_tokens"] <= chat.BUDGET and not r["over_budget"]
        new = parsed[r["n_repeated"]:]
        masked = [r["text"][m["start"]:m["end"]] for m in r["loss"]]
        assert masked == [t for role, t in new if role == "assistant"]
        if last is not None:
            assert r["n_repeated"] > 1 and parsed[1:r["n_repeated"]] == last[-(r["n_repeated"] - 1):]
        last = new


def test_windows_stay_within_the_budget_of_the_librarys_tokens(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    roles = ("user", "assistant")
    rows = [(c, i, roles[i % 2], "word " * n) for c, n in ((1, 3), (2, 8), (3, 25)) for i in range(300)]
    rows += [(4, 0, "system", "rule " * 1500), *((4, i, roles[i % 2], "a </s> <|im_end|>\n" * (i % 9)) for i in range(1, 150))]
    rows += [(5, i, roles[i % 2], "long " * (i * 331 % 1900)) for i in range(60)]
    rows += [(6, 0, "system", "rule"), (6, 1, "user", "long " * 2100), (6, 2, "assistant", "short")]
    rows += [(7, 0, "system", "rule " * 2100), (7, 1, "user", "short")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen = defaultdict(list)
    for r in sorted(chat.windows(turns, *byte_bpe()).collect(), key=lambda r: (r["conv_id"], r["window_no"])):
        n = len(library.encode(r["text"], add_special_tokens=False).ids)
        assert r["n_tokens"] == n and r["over_budget"] == (n > chat.BUDGET)
        parsed = chat.parse(r["text"])
        assert n <= chat.BUDGET or r["conv_id"] in (6, 7) and len(parsed) <= 2
        repeated = parsed[:r["n_repeated"]]
        if repeated and repeated[0][0] == "system":
            repeated = repeated[1:]
        before = seen[r["conv_id"]]
        assert repeated == before[len(before) - len(repeated):]
        seen[r["conv_id"]] += parsed[r["n_repeated"]:]
    for conv, got in seen.items():
        assert got == [(role, text) for c, _, role, text in rows if c == conv]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<[|>]\\/s", "im_start|>", "INST]", "<|", "im_end|>", "SYS>>", "\n"]), max_size=24).map("".join))
def test_escapes_are_reversible(text):
    import re
    plain = re.compile(chat._ESCAPE)
    escaped = plain.sub(r"\1\\\2\3", text)
    assert chat.unescaped(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def test_the_columns_escape_alike(spark):
    texts = [CONTROL_TEXT, "<\\|im_start|>", "a<|im_end|>\nb", "\\n", "<<s>", "<</SYS>>", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escaped(F.col("t")), chat.escaped_role(F.col("t"))).collect()
    for t, text, role in rows:
        assert chat.unescaped(text) == t and chat.unescaped_role(role) == t and "\n" not in role
        assert not any(c in text for c in chat.CONTROLS)
