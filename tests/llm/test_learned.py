"""The learned operators: accuracy on held-out documents and brute-force checks of their parts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from corpuscope.llm import common, langid, quality, rules, toxicity
from corpuscope.llm.queries import QUERIES, rule_list

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    return docs.merge(spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas(), how="left", on="doc_id").set_index("doc_id")


def result(spark, key):
    return QUERIES[key](spark, FOLDER).toPandas().set_index("doc_id")


def test_language_of_held_out_documents(spark, truth):
    got = result(spark, "op2_language").join(truth)
    held = got[got["held_out"]]
    assert len(held) > 200 and (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_toxicity_of_held_out_documents(spark, truth):
    got = result(spark, "op4_toxicity").join(truth)
    held = got[got["held_out"] & got["toxic"].notna()]
    assert ((held["score"] >= 0.7) == (held["toxic"] == 1)).mean() > 0.95


def test_quality_of_held_out_documents(spark, truth):
    got = result(spark, "op5_quality").join(truth)
    held = got[got["held_out"] & got["quality"].notna()]
    assert (held["kept"] == (held["quality"] == 1)).mean() > 0.95
    assert held.groupby("quality")["expected_grade"].mean().diff().iloc[-1] > 1


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside))


def test_rule_statistics_by_brute_force(spark, truth, odd):
    for folder in (FOLDER, odd):
        texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = sorted((str(d), *plain_statistics(t)) for d, t in texts)
        rows = QUERIES["op6_quality_rules"](spark, folder).collect()
        assert sorted((str(r[0]), *r[1:6]) for r in rows) == want
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    got = result(spark, "op6_quality_rules").join(truth)
    held = got[got["quality"].notna() & ~got["base_failed"]]
    assert (held[held["quality"] == 1]["kept"]).mean() > 0.99


def test_random_texts_have_the_plain_statistics():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices([*"ab \n\t\x0b\x0c\r\x1c\x85\xa0#|", "a b c d e ", "x\n"], k=rng.randint(0, 60)))
        assert rules.statistics(text)[:5] == plain_statistics(text)


def test_rules_find_planted_conjunctions(spark):
    rng = np.random.default_rng(1)
    n = 3000
    table = pd.DataFrame({f: rng.random(n) for f in rules.FEATURES})
    table["bad"] = (table["symbol_share"] >= 0.8) | ((table["upper_share"] >= 0.7) & (table["digit_share"] < 0.3))
    table["part"] = np.arange(n) % 3
    learned = rules.learn(table)
    hit = np.any([rules.covers(r, table) for r in learned], axis=0)
    assert (hit == table["bad"]).mean() > 0.97
    assert rules.learn(table.assign(bad=False)) == [] and rules.learn(table.iloc[:0]) == []
    rows = spark.createDataFrame([(12, 60, 30, 0, 0, 1, 0, 0, 0, 12, 0, 0), (5, 60, 0, 0, 0, 1, 0, 0, 0, 5, 0, 0)], rules.SCHEMA)
    kept = rows.select(rules.verdict([(rules.Condition("symbol_share", True, 0.4),)])).collect()
    assert [r[0] for r in kept] == [False, False]


def test_words_come_before_ngrams():
    counts = [("de", "haus", 9), ("en", "house", 9), ("en", "haushold", 2), ("de", "der", 5), ("en", "the", 5)]
    model = langid.fit(counts)
    assert model.evidence("haus") == [model.orders[0]["haus"]]
    assert model.predict(["haus haus", "housing", "the der", "", None, "42", "чужой"])[0][0] == "de"
    assert model.predict(["housing"])[0][0] == "en"
    found = model.predict(["чужой", "42"])
    assert found[0] == ("de", pytest.approx(0.5)) and found[1] == ("und", 0.0)
    unseen = model.evidence("hausen")
    assert all(r in model.orders[5].values() for r in unseen)
    assert langid.fit([]).predict(["text"]) == [("und", 0.0)]


def test_marginals_by_brute_force():
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(3, 2))
    lengths = [1, 5, 3, 7]
    chain = np.repeat(np.arange(4), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    emission = rng.normal(size=len(chain)) * 2
    got, expected = toxicity.marginals(emission, chain, place, trans)
    want, pairs, at = [], np.zeros((3, 2)), 0
    for n in lengths:
        total, p, seen = 0.0, np.zeros(n), np.zeros((3, 2))
        for tags in itertools.product((0, 1), repeat=n):
            s = sum(emission[at + i] * t for i, t in enumerate(tags))
            steps = [(2, tags[0]), *zip(tags, tags[1:])]
            w = np.exp(s + sum(trans[a, b] for a, b in steps))
            total += w
            p += w * np.array(tags)
            for a, b in steps:
                seen[a, b] += w
        want += list(p / total)
        pairs += seen / total
        at += n
    assert got == pytest.approx(want) and expected == pytest.approx(pairs)


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_of_a_run_equal_the_whole_run(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(block)
    lists = [["a"] * n + ["."] + ["b"] * k for n, k in ((1, 0), (5, 9), (20, 1), (0, 2))]
    owner, chain, place, follows, words = toxicity.chains(lists)
    assert place.max() < block and len(follows) == chain[-1] + 1
    emission, trans = rng.normal(size=len(words)) * 2, rng.normal(size=(3, 2))
    got = toxicity.marginals(emission, chain, place, trans, follows)
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    owner, chain, place, follows, words = toxicity.chains(lists)
    assert not follows.any()
    want = toxicity.marginals(emission, chain, place, trans, follows)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_long_runs_without_an_end_mark(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), np.array([[0.0, -3.0], [0.0, 1.0], [0.0, -3.0]]), (0.0, 1.0))
    scores, _ = model.predict(["word " * 200_000])
    assert np.isfinite(scores).all()


def plain_prediction(model, text):
    """A text's language by plain dictionaries, word by word."""
    logs = model.logs.astype(float)
    total, each = np.zeros(len(model.languages)), []
    for word in re.findall(r"\w+", "".join(c if c.isalpha() else " " for c in text or "")):
        w = word.lower()
        padded = f"_{w}_"
        rows = [model.orders[0][w]] if w in model.orders[0] else []
        for n in range(langid.LONGEST, 0, -1):
            source = padded if n > 1 else w
            rows = rows or [model.orders[n][source[i:i + n]] for i in range(len(source) - n + 1) if source[i:i + n] in model.orders[n]]
        mean = logs[rows].mean(0) if rows else np.zeros(len(total))
        p = np.exp(mean - mean.max())
        p /= p.sum()
        total += np.log(p)
        each.append(p)
    if not each:
        return langid.UNKNOWN, 0.0
    best = int(np.argmax(total))
    return model.languages[best], float(np.mean([p[best] for p in each]))


ODD_TEXTS = ["日本語 テキスト", "½ ① Ⅷ", "½ ① Ⅷ haus", "чужой", "", None, "42 _ -", "haus " * 3, "housing the", "der ① thé", "x" * 90 + " the"]


def test_prediction_by_plain_dictionaries():
    counts = [("de", "haus", 9), ("en", "house", 9), ("en", "haushold", 2), ("de", "der", 5), ("en", "the", 5), ("fr", "thé", 4)]
    for text in ODD_TEXTS:  # each alone, as the only new words of a batch
        model = langid.fit(counts)
        lang, score = model.predict([text])[0]
        want = plain_prediction(model, text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-5), text
    model = langid.fit(counts)
    together = model.predict(["the haus der", *ODD_TEXTS])[1:]
    assert [x[0] for x in together] == [plain_prediction(model, t)[0] for t in ODD_TEXTS]
    assert model.predict(["½ ① Ⅷ"]) == [("und", 0.0)]


def test_language_query_with_an_unseen_script(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(100_000 + i, t, None) for i, t in enumerate(ODD_TEXTS)], docs.schema)
    docs.unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op2_language"](spark, str(tmp_path)).collect()}
    assert len(got) == docs.count() + len(ODD_TEXTS) and got[100_001] == got[100_004] == got[100_005] == got[100_006] == "und"
    assert got[100_000] != "und"
    stage = corpus_pipeline.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert not {100_001, 100_004, 100_005, 100_006} & {r["doc_id"] for r in stage.select("doc_id").collect()}


def test_one_id_in_a_third_of_the_rows_takes_one_place(spark):
    rows = [(i, f"text {i}", i % 2, i % 3 % 2) for i in range(900)] + [(7, f"text {i}", 1, 1) for i in range(450)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    got = common.labelled(docs, labels, 100).collect()
    assert got == common.labelled(docs.repartition(3), labels.repartition(2), 100).collect()
    ids = [r["doc_id"] for r in got]
    assert 40 <= len(ids) <= 100 and len(set(ids)) == len(ids) and ids != sorted(ids)
    sample = common.bounded_sample(docs, "doc_id", 100).collect()
    assert len(sample) <= 100 and len({r["doc_id"] for r in sample}) == len(sample)


def test_verdict_is_a_plain_reading_of_the_list(spark):
    """Rules learned from the table, applied in Python and by the emitted expression."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    learned = rule_list(docs, labels)
    assert learned
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op6_quality_rules"](spark, FOLDER).collect()}
    for r in docs.select("doc_id", "text").collect():
        m = dict(zip((c.split()[0] for c in rules.SCHEMA.split(", ")), rules.statistics(r["text"])))
        words, chars = m["n_words"], m["word_chars"]
        share = lambda a, b: a / b if b else 0.0
        f = {"n_words": float(words), "mean_word_chars": share(chars, words), "symbol_share": share(m["n_symbols"], chars),
             "mark_share": share(m["n_marks"], chars), "upper_share": share(m["n_upper"], chars), "digit_share": share(m["n_digits"], chars),
             "dup_line_share": share(m["n_dup_lines"], m["n_lines"]), "repeat_share": share(m["n_repeat_words"], words),
             "distinct_share": share(m["n_distinct"], words), "adjacent_share": share(m["n_adjacent"], words), "bare_share": share(m["n_bare"], words)}
        bad = words < 10 or 100 * m["n_repeat_words"] > 20 * words
        bad = bad or any(all((f[c.feature] >= c.cut) == c.at_least for c in rule) for rule in learned)
        assert got[r["doc_id"]] == (not bad)


def test_grades_by_plain_sums():
    """The latent value, tails and expected grade of a fitted model from its numbers alone."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["good", "bad", "fine", "x1", "…"], k=rng.randint(0, 30))) for _ in range(120)]
    model = quality.fit(texts, [float(i % 3) for i in range(120)])
    for t in [*texts[:20], None, ""]:
        latent = model.latent(t)
        tails = [1 / (1 + math.exp(min(max(c - latent, -700), 700))) for c in model.thresholds]
        got = model.tails(np.array([latent]))
        assert got[0] == pytest.approx(tails)
        grades = list(model.grades)
        assert model.expected(got)[0] == pytest.approx(grades[0] + sum((b - a) * p for a, b, p in zip(grades, grades[1:], tails)))


def test_spans_are_offsets_of_the_text():
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts, labels = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            for _ in range(3):
                t[rng.randrange(40)] = rng.choice(["scum", "moron"])
        texts.append(" ".join(t) + ".")
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    score, spans = model.predict(["waa wab SCUM wac. İ moron", "waa wab", "", None])
    assert [("waa wab SCUM wac. İ moron"[a:b]) for a, b, _ in spans[0]] == ["SCUM", "moron"]
    assert score[0] > 0.7 > score[1] and score[2] == score[3] < 0.7 and spans[1:] == [[], [], []]
    assert toxicity.fit([], []).predict(["x"])[0][0] < 0.01


def test_ordinal_model_orders_grades():
    rng = random.Random(5)
    texts, grades = [], []
    for i in range(400):
        g = i % 4
        texts.append(" ".join(rng.choice(["bad", "worse"]) if rng.random() > g / 3 else rng.choice(["good", "fine"]) for _ in range(30)))
        grades.append(float(g))
    model = quality.fit(texts, grades)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    latent = np.array([model.latent(t) for t in texts])
    tails = model.tails(latent)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(model.expected(tails), grades)[0, 1] > 0.9
    assert quality.fit([], []).latent("a") == 0 and quality.fit(["a"], [2.0]).expected(np.zeros((1, 0))) == [2.0]
