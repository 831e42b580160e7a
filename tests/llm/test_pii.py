"""Personal data against the plain patterns, and disguises that are made from them."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import pii
from corpuscope.llm.queries import QUERIES

from .conftest import ROWS, SMALL

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", r"\x20\-"), "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), k, m.end()) for k, name in enumerate(PATTERNS) for m in re.finditer(PATTERNS[name], text) if sound(name, m[0])]
    return sorted(found)


def odd_texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@@", ".", "..", "-", " ", "+", "(", ")", "1", "12", "255", "256", "1.2.3.4", "+1 ", "4111 1111 1111 1111", "007",
             "é", "x@y.z", "@y.z", "55-55", "\n", "４", "%", "_", "+49 171 2345678", "9" * 20]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]


def test_spans_as_written_are_those_of_the_patterns():
    for t in odd_texts():
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_no_time():
    for t in ("x" * 300_000, "1" * 300_000, "1 " * 200_000, "1." * 200_000, "@" * 100_000, "+1" + "(" * 100_000, "a@" * 50_000, "one " * 50_000,
              "a at b dot " * 20_000):
        pii.all_spans(t)


SECRETS = {"email": ["john.doe@example.com", "that.92@mail2.example.org", "a_b@shop.co.uk"], "ip": ["192.168.10.254", "8.8.4.4"],
           "card": ["4111111111111111", "5500 0055 5555 5559", "3782-822463-10005"], "phone": ["+1 (743) 555-3824", "+4917123456789"]}
WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
GLYPHS = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х"}


def spelled(s):
    s = s.replace("+", "plus ").replace(".", " dot ")
    return re.sub(" +", " ", re.sub(r"[0-9]", lambda m: f" {WORDS[int(m[0])]} ", s)).strip()


DISGUISES = {
    "email": [lambda s: s.replace("@", " [at] "), lambda s: s.replace("@", " (at) ").replace(".", " (dot) "), lambda s: s.replace("@", "{AT}"),
              lambda s: s.replace("@", " at ").replace(".", " dot "), lambda s: s.replace("@", "＠"), lambda s: s.replace("@", "&#64;"),
              lambda s: "".join(GLYPHS.get(c, c) for c in s), lambda s: s.replace("@", " @ "), lambda s: s.replace("@", "​@"),
              lambda s: s.replace(".", "[.]"), lambda s: s.replace("@", " arroba ").replace(".", " punto ")],
    "ip": [lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", " dot "), spelled, lambda s: s.replace(".", " (dot) "),
           lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s)],
    "card": [spelled, lambda s: "".join(chr(ord(c) + 0x630) if c.isdigit() else c for c in s), lambda s: s.replace("1", "l", 2).replace("0", "O", 2),
             lambda s: s[:8] + "​" + s[8:], lambda s: s.replace(" ", " ").replace("-", "–").replace("5", "５")],
    "phone": [spelled, lambda s: s.replace("+", "＋"), lambda s: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in s),
              lambda s: s.replace("+", "plus ")]}


@pytest.mark.parametrize("kind", SECRETS)
def test_disguised_data_is_found_where_it_stands(kind):
    for secret in SECRETS[kind]:
        for i, disguise in enumerate(DISGUISES[kind]):
            hidden = disguise(secret)
            text = f"Nothing here, éà. The word: {hidden} und noch etwas"
            begin, k = len("Nothing here, éà. The word: "), pii.KINDS.index(kind)
            base, spans = pii.all_spans(text)
            assert (begin, k, begin + len(hidden)) in spans, (i, hidden, spans)
            assert set(base) <= set(spans)
            assert hidden not in pii.redacted(text, spans)


def test_clean_texts_have_no_hidden_spans(spark):
    texts = ["look at this point in time", "available at example.com today", "the dot at the end", "one two three four five six",
             "plus one or two", "he was at home. dot com was a time", "arrived at noon dot", "1,000 or 2.000 and 3 dots", "a point at issue",
             "room 4l at 10.30", "un deux trois, un deux trois", "en 2010–2015", "m² of 3½", "à la carte @ home"]
    for t in texts:
        assert pii.all_spans(t) == ([], []), t
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect():
        base, spans = pii.all_spans(r["text"] or "")
        assert base == spans == plain(r["text"] or "")


def test_offsets_lead_back_through_both_transducers():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choices("ab１２ @.​é", k=40))
        first = pii.rewrite(text, pii.character_edits(text))
        for _ in range(10):
            a = rng.randrange(len(first.text) or 1)
            b = rng.randint(a + 1, max(len(first.text), a + 1))
            begin, end = first.back(a, b)
            if b <= len(first.text):
                assert pii.rewrite(text[begin:end], pii.character_edits(text[begin:end])).text == first.text[a:b]


def test_query_over_odd_rows(spark, odd):
    got = sorted(map(str, QUERIES["op12_pii"](spark, odd).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()))
    want = []
    for d, t, *_ in ROWS:
        spans = plain(t or "")
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        want.append(f"Row(doc_id={d}, " + ", ".join(f"n_{name}={[k for _, k, _ in spans].count(i)}" for i, name in enumerate(pii.KINDS))
                    + f", base_sha256='{digest}')")
    assert got == sorted(want)


def test_redaction_of_a_column(spark):
    rows = spark.createDataFrame([(None,), ("",), ("mail a@b.co or a (at) b (dot) co",)], "text string")
    assert [r[0] for r in rows.select(pii.redact(F.col("text"))).collect()] == [None, "", "mail <email> or <email>"]
