"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, chat, collocations, langid, minhash, packing, pieces, pii, quality, resampling, rules, tokens, toxicity, vectors)
from .common import bounded_batches, held_out, labelled, table

_KEYS = itertools.count()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def byte_bpe() -> tuple[str, str]:
    return bpe.read(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def shared(spark: SparkSession, model):
    """A model, bounded by its training sample and hashed size, sent once to each executor."""
    key = next(_KEYS)
    return spark.sparkContext.broadcast((key, model))


def language_model(spark: SparkSession, documents: DataFrame):
    """Learned from the documents outside the held-out fold."""
    return shared(spark, langid.train(documents.where(~held_out(F.col("doc_id")))))


def rule_list(documents: DataFrame, labels: DataFrame) -> list:
    """Rules learned from labelled documents outside the held-out fold that pass the base tests."""
    rows = labelled(documents, labels.where(F.col("quality").isNotNull()), rules.TRAINING_DOCUMENTS)
    measured = rows.select("doc_id", "quality", rules.measure(F.col("text")).alias("m")).select("doc_id", "quality", "m.*")
    learned = measured.where(f"not ({rules.BASE_FAILED})").select(
        (F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("part"),
        *(F.expr(sql).alias(name) for name, sql in rules.FEATURES.items()))
    return rules.learn(learned.toPandas())


@query
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it. Null and empty texts have no ids; equal rows get equal ones."""
    bounded_batches(spark)
    vocabulary = shared(spark, pieces.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model")))
    coded = table(spark, folder, "documents").select("doc_id", "text", pieces.round_trip(F.col("text"), vocabulary).alias("r"))
    return coded.select("doc_id", "r.ids", F.size("r.ids").cast("long").alias("n_ids"), (
        F.col("r.text") == F.coalesce("text", F.lit(""))).alias("decodes_to_text"))


@query
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text. Null texts and those without a letter are ``und`` with score 0, as all are where nothing is learned."""
    bounded_batches(spark)
    docs = table(spark, folder, "documents")
    found = langid.language(F.col("text"), language_model(spark, docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.*")


@query
def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every row. Texts without words are classes of their own; rows without an id have none; equal rows share theirs."""
    bounded_batches(spark)
    found = minhash.near_duplicates(table(spark, folder, "documents"), lambda model: shared(spark, model))
    return found.select("doc_id", "class_id", "kept")


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every whole text. Null and empty texts have the lowest; without labels of both kinds all score alike."""
    bounded_batches(spark)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    sample = labelled(docs, labels.where(F.col("toxic").isNotNull()), toxicity.TRAINING_DOCUMENTS)
    rows = sample.select("text", "toxic").toPandas()
    model = shared(spark, toxicity.fit(rows["text"].tolist(), rows["toxic"].tolist()))
    found = toxicity.toxicity(F.col("text"), model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.score", (F.col("f.score") >= 0.7).cast("int").alias("predicted"), "f.spans")


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 poor, 1 well formed but toxic, 2 good."""
    bounded_batches(spark)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rated = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    sample = labelled(docs, rated, quality.TRAINING_DOCUMENTS)
    rows = sample.select("text", (F.col("quality") * (2 - F.col("toxic"))).cast("double").alias("grade")).toPandas()
    model = quality.fit(rows["text"].tolist(), rows["grade"].tolist())
    # selection asks for at least the second grade; one grade alone selects all
    enough = F.coalesce(F.try_element_at("f.tail", F.lit(1)), F.lit(1.0))
    found = quality.grade(F.col("text"), shared(spark, model))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("f")).select(
        "doc_id", "held_out", "f.expected_grade", enough.alias("tail_probability"), (enough >= 0.5).alias("kept"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every whole text. Null texts have none and fail; without labels only the base tests count."""
    bounded_batches(spark)
    docs = table(spark, folder, "documents")
    learned = rule_list(docs, table(spark, folder, "labels"))
    rows = docs.select("doc_id", rules.measure(F.col("text")).alias("m")).select("doc_id", "m.*")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       F.expr(rules.BASE_FAILED).alias("base_failed"), rules.verdict(learned).alias("kept"))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text; null and empty texts have none."""
    bounded_batches(spark)
    docs = table(spark, folder, "documents")
    n = tokens.token_count(F.col("text"), *byte_bpe())
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                       n.alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)


#: The conversation that is formatted beside those of the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Read back from the formatted windows, a row a conversation.

    Null texts are empty; turns with equal numbers go by role and text; rows without a conversation are left out.
    """
    bounded_batches(spark)
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.windows(turns, *byte_bpe()))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document. Null texts are empty, so each row has at least its end id; equal rows are packed each."""
    bounded_batches(spark)
    return packing.pack(table(spark, folder, "documents"), *byte_bpe())


@query
def op10_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links of every vector. What is null, zero or not finite links with nothing; equal rows count each."""
    bounded_batches(spark)
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every row. Null texts have no features; equal rows are drawn one by one; ids that are null come last among ties."""
    bounded_batches(spark)
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every whole text, as written and disguised; null texts have none."""
    bounded_batches(spark)
    return table(spark, folder, "documents").select("doc_id", pii.personal_data(F.col("text")).alias("f")).select("doc_id", "f.*")


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first phrases of each language; a null language is ``und``, null texts are empty, equal rows count each."""
    bounded_batches(spark)
    return collocations.collocations(table(spark, folder, "documents"))


#: Links and what they reach, by comparing all vectors of a label.
ORACLES["op10_vectors"] = """
with recursive sound as (
  select vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and list_sum(list_transform(embedding::double[], lambda e: e * e)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id
    and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select vec_id as a, vec_id as b from sound union select r.a, l.b from reach r join links l on r.b = l.a),
counts as (select a, count(*) as n from links group by 1),
roots as (select a, min(b) as c from reach group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, vec_id = coalesce(c, vec_id) as kept
from embeddings left join counts on counts.a = vec_id left join roots on roots.a = vec_id"""

#: Features of every text, their checksums byte by byte, gains, noise and ranks.
ORACLES["op11_resampling"] = r"""
with recursive steps as (select i, i::bigint as c, 0 as k from range(256) t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
texts as (select 'd' as side, row_number() over () as id, text from documents union all
  select 'b', row_number() over (), text from benchmark),
words as (select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
features as (
  select side, id, unnest(w) as f from words union all
  select side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words),
named as (select f, hex(encode(f)) as h from (select distinct f from features)),
hashed as (select f, xor(4294967295, list_reduce(
    list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint)) % 10000 as bucket from named, crc),
placed as (select side, id, bucket from features join hashed using (f)),
counts as (select b as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range(10000) r(b)
  left join (select bucket, count(*) as s from placed where side = 'd' group by 1) x on x.bucket = b
  left join (select bucket, count(*) as t from placed where side = 'b' group by 1) y on y.bucket = b),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double
  / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
weighed as (select id, count(*)::bigint as n, sum(gain)::bigint as total from placed join gains using (bucket) where side = 'd' group by 1),
docs as (select row_number() over () as id, doc_id, text from documents),
scored as (select doc_id, len(w) as n_words, coalesce(n, 0) as n_features,
    case when n is null then 0 else ((total - ((total % n) + n) % n) // n)::bigint end as weight,
    floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as noise
  from docs join words on words.side = 'd' and words.id = docs.id left join weighed on weighed.id = docs.id),
drawn as (select *, weight + noise as score, n_words >= 20 as able from scored),
ranked as (select *, case when able then row_number() over (partition by able order by score desc, doc_id nulls last, n_features) end as place,
  count(*) filter (able) over () as total from drawn)
select doc_id, n_features::bigint as n_features, weight, score, case when place <= 25 * total // 100 then place::bigint end as rank
from ranked"""

#: All phrases of up to five words, the weakest cut of the frequent ones, and those not inside longer ones.
ORACLES["op13_collocations"] = r"""
with texts as (select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
pieces as (select lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') as w from texts),
spans as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase
  from pieces, range(1, 6) t(k) where len(w) >= k),
n as (select lang, sum(len(w)) as n from pieces group by 1),
f as materialized (select lang, phrase, any_value(k) as k, count(*) as f from spans group by 1, 2 having count(*) >= 100),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
halves as (select lang, phrase, a, k, j, array_to_string(w[1 : j], ' ') as x, array_to_string(w[j + 1 : k], ' ') as y
  from (select *, unnest(range(1, k)) as j from c)),
cuts as (select h.lang, h.phrase, h.a, n.n, h.j, x.f as l, y.f as r, (1000::hugeint * h.a * n.n) // (x.f::hugeint * y.f) as score
  from halves h join n on n.lang = h.lang join f x on x.lang = h.lang and x.phrase = h.x join f y on y.lang = h.lang and y.phrase = h.y),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as i from cuts) where i = 1),
inside as (select lang, phrase, max(a) as most from (
  select lang, a, array_to_string(w[i : i + m - 1], ' ') as phrase from (
    select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c))) group by 1, 2),
kept as (select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.most is null or i.most < b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= 2000"""
