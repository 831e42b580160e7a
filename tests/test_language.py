"""Trigram language detection: against brute force, and its accuracy on labelled text."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.registry import views
from checks.views import LANGS
from corpuscope.operators import language as lg

EN = "the quick brown fox jumps over the lazy dog and runs through the forest with the others"
DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft durch den Wald mit anderen"


def fold(text):
    spaced = re.sub(r"[^a-zäöüß]+", " ", text.lower())
    return " " + re.sub("[^a-z ]", "~", spaced).strip() + " "


def grams(text):
    f = fold(text)
    return [f[i:i + 3] for i in range(len(f) - 2)]


@pytest.fixture(scope="module")
def profile(spark):
    docs = spark.createDataFrame([(EN, "en"), (DE, "de"), ("ignored", "xx")], "text string, lang string")
    return lg.train_profile(docs, ("de", "en")).cache()


def test_trigrams_overlap(spark):
    df = spark.createDataFrame([("Ab, é1c!",)], "t string")
    assert df.select(lg.trigrams("t").alias("g")).first().g == [" ab", "ab ", "b ~", " ~ ", "~ c", " c "]


def test_profile_equals_counting(profile):
    counts = {"en": Counter(grams(EN)), "de": Counter(grams(DE))}
    got = {r.trigram: (r.lp_de, r.lp_en) for r in profile.collect()}
    assert set(got) == set(counts["en"]) | set(counts["de"])
    for gram, (de, en) in got.items():
        for lang, value in (("de", de), ("en", en)):
            total = sum(counts[lang].values())
            assert value == round(math.log((counts[lang][gram] + 1) / (total + 28 ** 3)) * 1_000_000)


def share(spark, profile, text):
    df = spark.createDataFrame([("a/b", text)], "full_name string, content string")
    return lg.readme_language(df, profile, ("de", "en")).first()


@pytest.mark.parametrize("text, conf, lang", [
    (EN, 1.0, "en"), (DE, 0.0, "non-en"), (f"{EN}\n{DE}", 0.5, "non-en"), (f"{EN}\n" * 4 + DE, 0.8, "en"),
    (f"{EN}\n```\n{DE}\n```", 1.0, "en"), (f"{EN}\n" + "x" * 19, 1.0, "en"),
    (f"{EN}\n" + "zqzq" * 6, 0.5, "non-en"), ("", None, None), (None, None, None), ("1234 !!", None, None),
    ("你好", None, None)])
def test_english_share(spark, profile, text, conf, lang):
    got = share(spark, profile, text)
    assert (got.readme_lang_conf, got.readme_lang) == (conf, lang)


def test_short_text_falls_back_to_the_whole(spark, profile):
    got = share(spark, profile, "the dog\nand fox")
    assert 0.8 < got.readme_lang_conf <= 1.0 and got.readme_lang == "en"
    # surely German: the probability of English is too low to be reported
    assert share(spark, profile, "der Hund\nund Wald").readme_lang_conf is None


def test_profile_size_is_bounded_by_the_alphabet(spark):
    docs = spark.range(2000).selectExpr("cast(md5(cast(id as string)) as string) as text", "'en' as lang")
    rows = lg.train_profile(docs, ("en",))
    assert rows.count() <= lg.ALPHABET_CUBED


@pytest.mark.parametrize("seed", ["a", "b"])
def test_accuracy_on_held_out_documents(spark, seed):
    """Trained on one half of the labelled documents and judged on the whole texts of the other."""
    docs = views(spark, "/root/testdata/sf0.01").documents.withColumn(
        "half", F.pmod(F.hash("doc_id", F.lit(seed)), F.lit(2)))
    profile = lg.train_profile(docs.filter("half = 0"), LANGS)
    scored = lg.score_texts(docs.filter("half = 1"), profile, LANGS, ["doc_id", "lang"], "text")
    right = scored.agg(F.avg(F.expr("cast(coalesce(best_lang = lang, false) as int)"))).first()[0]
    assert right > 0.98
