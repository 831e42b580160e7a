"""Scalar functions: exact values, quirks, and brute force on small fixtures."""

import base64
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpuscope import taxonomy as tx
from corpuscope.functions import dates, text as fx
from corpuscope.operators import mentions as mn


def one(spark, expression, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (None,)
    schema = ", ".join(f"{n} {_kind(v)}" for n, v in zip(names, row))
    return spark.createDataFrame([row], schema).select(expression.alias("out")).first().out


def _kind(value):
    return {int: "bigint", float: "double", bool: "boolean", list: "array<string>"}.get(type(value), "string")


# -- dates ---------------------------------------------------------------------------

@pytest.mark.parametrize("ts, days", [
    ("2026-08-01 23:59:00", 0), ("2026-08-01 00:00:00", 1), ("2026-08-02 00:00:00", 0),
    ("2026-08-02 00:00:01", -1), (None, None)])
def test_days_since_counts_elapsed_days(spark, ts, days):
    assert one(spark, dates.days_since(F.to_timestamp("t"), "2026-08-02 00:00:00"), t=ts) == days


@pytest.mark.parametrize("n, days, month, year", [
    (9, 45, 6.0, 73.0), (7, 146, 7 / (146 / 30), 17.5), (31, 1000, 0.93, 31 / (1000 / 365)),
    (17, 0, 0.0, 0.0), (17, -3, 0.0, 0.0)])
def test_rates(spark, n, days, month, year):
    assert one(spark, dates.commits_per_month("n", "d"), n=n, d=days) == pytest.approx(month)
    assert one(spark, dates.releases_per_year("n", "d"), n=n, d=days) == pytest.approx(year)


@pytest.mark.parametrize("raw, parsed", [
    ("2024-01-15T00:00:00Z", "2024-01-15 00:00:00"),
    ("2024-01-15T03:00:00+02:00", "2024-01-15 01:00:00"), ("not a date", None)])
def test_parse_iso(spark, raw, parsed):
    assert one(spark, dates.parse_iso(F.col("t")).cast("string"), t=raw) == parsed


# -- counts --------------------------------------------------------------------------

@pytest.mark.parametrize("body, terms, n", [
    ("Mistral or Gemini? Gemini it was, then gemini once more.", ["Gemini", "Mistral", "Llama"], 4),
    ("CURSOR, cursor and CuRsOr; copilot", ["Copilot", "Cursor"], 4), ("", ["x"], 0), (None, ["x"], 0),
    ("Claude Code", ["Claude", "Claude Code"], 2), ("aaaa", ["aa"], 2), ("pytest", tx.README_TEST_TERMS, 2)])
def test_keyword_count(spark, body, terms, n):
    assert one(spark, fx.keyword_count("t", terms), t=body) == n


def test_library_hits_count_presence(spark):
    assert one(spark, fx.library_hits(F.lower("t"), tx.AI_LIBRARIES), t="openai openai LangChain") == 2
    assert one(spark, fx.library_hits(F.lower("t"), tx.AI_LIBRARIES), t=None) == 0


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aAbé -", max_size=30), min_size=1, max_size=20))
def test_keyword_count_equals_scanning(spark, texts):
    def scan(s, term):
        s, term, i, n = s.lower(), term.lower(), 0, 0
        while (i := s.find(term, i)) >= 0:
            n, i = n + 1, i + len(term)
        return n

    terms = ["a", "ab", "é", "a b", "aa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in rows.select("i", fx.keyword_count("t", terms).alias("n")).collect()}
    assert got == {i: sum(scan(s, t) for t in terms) for i, s in enumerate(texts)}


# -- encoded input -------------------------------------------------------------------

@pytest.mark.parametrize("raw", [b"plain", "größe".encode(), b"a\xffb\xc3(", b""])
def test_decode_content_drops_bad_bytes(spark, raw):
    encoded = base64.encodebytes(raw).decode()
    assert one(spark, fx.decode_content("c"), c=encoded) == raw.decode(errors="ignore")


@pytest.mark.parametrize("raw, out", [
    ("['ai', 'testing']", ["ai", "testing"]), ('["x"]', ["x"]), ("[]", []), ("nonsense", []), ("", []), (None, [])])
def test_parse_topics(spark, raw, out):
    assert one(spark, fx.parse_topics("t"), t=raw) == out


# -- tutorial rules ------------------------------------------------------------------

@pytest.mark.parametrize("body, topics, hit", [
    ("a/b Tutorials for all", [], ("tutorial", "tutorials")), ("a/labs tools", [], None),
    ("a/lab tools", [], ("lab", "lab")), ("a/b", ["demo-app"], None), ("a/b", [" Demo "], ("demo", "demo")),
    ("a/b Hello World in Go", [], ("hello world", "hello world")),
    ("a/b a demo course", [], ("demo", "demo")), ("a/b machine learning", [], None),
    ("a/b exerciseses", [], None), ("x/hello-world", [], None), (None, [], None)])
def test_tutorial_hit(spark, body, topics, hit):
    got = one(spark, fx.tutorial_hit("t", "p"), t=body, p=topics)
    assert (tuple(got) if got else None) == hit


# -- README text ---------------------------------------------------------------------

def test_clean_readme(spark):
    md = "# Title\n```py\ncode\n``` and `x = 1` see https://a.b/c?d=1 now [link](y)!"
    assert re.sub(" +", " ", one(spark, fx.clean_readme("t"), t=md)) == " Title\n and see now link y "


def test_text_lines_need_twenty_letters(spark):
    long, short = "a" * 20, "b" * 19 + " 123456"
    assert one(spark, fx.text_lines("t"), t=f"  {long} \r\n{short}\x0b{long}x é{long}") == [
        long, long + "x", "é" + long]


@pytest.mark.parametrize("share, lang", [(0.8, "en"), (0.79, "non-en"), (0.0, "non-en"), (None, None)])
def test_readme_lang(spark, share, lang):
    df = spark.createDataFrame([(share,)], "s double").select(fx.readme_lang("s").alias("l"))
    assert df.first().l == lang


# -- mentions ------------------------------------------------------------------------

def mentions(spark, text, artifact="commit_message"):
    df = spark.createDataFrame([("a/b", text)], "full_name string, body string")
    return {r.keyword: r for r in mn.detect_mentions(df, artifact, "body").collect()}


@pytest.mark.parametrize("text, found", [
    ("Claude Code did it", {"Claude", "Claude Code"}), ("GPT-4o and nothing else", {"GPT-4o"}),
    ("gpt-4, GPT-4o", {"GPT-4", "GPT-4o"}), ("see https://openai.com/x", set()),
    ("mail llama@example.org", set()), ("unclaude claudes Claude2", set()), ("_claude_", {"Claude"}),
    ("\U0001F600\U0001F600 Claude", {"Claude"}), ("éclaude", {"Claude"}), ("", set()), (None, set()),
    ("GEMİNI ſTARCODER", {"Gemini", "StarCoder"}), ("Llama 3", {"Llama", "Llama 3"})])
def test_bounded_hits(spark, text, found):
    assert set(mentions(spark, text)) == found


def test_offset_counts_characters(spark):
    df = spark.createDataFrame([("a/b", "\U0001F600\U0001F600 the Claude")], "full_name string, body string")
    assert mn.keyword_positions(df, "body").first().pos == 7


def test_snippet_joins_words_across_a_line_break(spark):
    got = mentions(spark, "foo\nbar Claude\t\t x")["Claude"]
    assert got.context_snippet == "foobar Claude x"


def test_context_is_clipped_to_the_text(spark):
    body = "x " * 100 + "Claude" + " y" * 100
    got = mentions(spark, body)["Claude"].context_snippet
    assert got == ("x " * 35 + "Claude" + " y" * 35).strip()


@pytest.mark.parametrize("text, kind, score, related", [
    ("Claude was unused", "direct-usage", 0.35, False), ("plan to use Claude", "speculative-planned", 0.35, False),
    ("Claude made a fixture", "reference", 0.70, True), ("Claude pytest", "reference", 0.55, True),
    ("Claude action", "tool-integration", 0.35, False)])
def test_mention_fields(spark, text, kind, score, related):
    got = mentions(spark, text)["Claude"]
    assert (got.mention_type, got.confidence_score, got.testing_relevant) == (kind, score, related)


def test_first_class_in_order_wins(spark):
    assert one(spark, fx.classify_context("t"), t="fix test with test data") == "test_data_synthesis"
    assert one(spark, fx.classify_context("t"), t="nothing") == "unspecified"


@pytest.mark.parametrize("message, tool", [
    ("x\n\nCo-authored-by: GitHub Copilot <a@b.c>", "Copilot"), ("co-authored-by:\n someone, CLAUDE", "CLAUDE"),
    ("Co-authored-by: Jane\nDoe uses Claude", None), ("Co-authored-by: Jane <j@d.e>", None),
    ("Co-authored-by: chatgpt", "chatgpt"), ("Claude", None), (None, None)])
def test_trailer(spark, message, tool):
    assert one(spark, fx.trailer_tool("m"), m=message) == tool


@pytest.mark.parametrize("name, description, topics, catalog", [
    ("a/awesome-x", None, [], True), ("a/x-awesome", None, [], True), ("a/awesomeness", None, [], True),
    ("a/not-awesomely", "", [], False), ("a/dev-resources", None, [], True), ("a/cheatsheet", None, [], False),
    ("a/my-cheat-sheet", None, [], True), ("a/b", "A curated list of x", [], True), ("a/b", None, ["curated", "list"], False),
    ("a/b", None, ["a list of"], True), ("a/b", "collections of", [], False)])
def test_catalog_flag(spark, name, description, topics, catalog):
    assert one(spark, fx.catalog_flag("n", "d", "t"), n=name, d=description, t=topics) is catalog


ALPHABET = "aA1 -.o\n\U0001F600é@:/"


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=ALPHABET, max_size=25), min_size=1, max_size=15))
def test_positions_equal_scanning(spark, texts):
    """Against a character scan; the texts hold neither URLs nor addresses."""
    words = ("a", "a-", "o1", "A a")
    texts = [t.replace("@", "").replace("://", "") for t in texts]

    def edge(s, i):
        return not (0 <= i < len(s) and s[i].isascii() and s[i].isalnum())

    def scan(s, w):
        return next((i for i in range(len(s)) if s[i:i + len(w)].lower() == w.lower()
                     and edge(s, i - 1) and edge(s, i + len(w))), None)

    tax = tx.Taxonomy(genai_keywords=words)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    got = {(r.i, r.keyword): r.pos for r in mn.keyword_positions(df, "body", tax).collect()}
    want = {(i, w): scan(s, w) for i, s in enumerate(texts) for w in words if scan(s, w) is not None}
    assert got == want
