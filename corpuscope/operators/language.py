"""Natural language of READMEs from a letter-trigram profile.

The detector is trained here on a labelled corpus by counting, so its verdicts are judged
by accuracy on labelled text and are not meant to equal those of any other detector.

Text is folded to 28 symbols (a-z, ``~`` for any other letter, space), so a profile has at
most 28**3 = 21,952 rows however large the corpus is. For scoring it becomes one dense table
with a cell for every trigram number and language, and a text is scored within its row: its
trigrams are numbered and the cells summed, without a join or a row per trigram.
Log-probabilities are whole numbers (millionths), which makes sums exact and independent
of the order in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import taxonomy as tx
from ..functions import text as fx
from .files import chosen_readme, readme_files

ALPHABET_CUBED = 28 ** 3
#: Trigram numbers: three symbols of five bits.
CELLS = 32 ** 3
SCALE = 1_000_000
#: Bytes of text that are summed at a time.
STRETCH = 1 << 20
MIN_PROBABILITY = 0.1


def fold_letters(text) -> Column:
    """Lower case, runs of non-letters to one space, other letters to ``~``, padded by spaces."""
    spaced = F.regexp_replace(F.lower(fx.as_col(text)), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, "[^a-z ]", "~")), F.lit(" "))


def trigrams(text) -> Column:
    """All overlapping trigrams, found in one pass by a zero-width match."""
    return F.regexp_extract_all(fold_letters(text), F.lit("(?=(...))"), F.lit(1))


def score_column(language: str) -> str:
    return f"lp_{language}"


class Folding:
    """:func:`fold_letters` for Arrow arrays: what each character is folded to, looked up in a table.

    The table is made by Spark's own functions. A character that lower case makes several of is replaced first.
    """

    def __init__(self, spark: SparkSession) -> None:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        chars = spark.range(0xD800).union(spark.range(0xE000, 0x110000)).select("id", F.lower(char).alias("lower"))
        # within the blanks that a folded text is padded by
        told = chars.select("id", "lower", F.substring(fold_letters("lower"), 2, 1).alias("symbol")).where(
            (F.length("lower") > 1) | ~F.col("symbol").isin("", " ")).toArrow()
        ids, several = told["id"].to_numpy(), pc.greater(pc.utf8_length(told["lower"]), 1).to_numpy(zero_copy_only=False)
        self.several = {chr(i): lower for i, lower in zip(ids[several].tolist(), told["lower"].filter(pa.array(several)).to_pylist())}
        self.table = np.full(int(ids.max()) + 2, ord(" "), np.uint8)  # no letter lies behind the last place
        self.table[ids] = [ord(x[:1] or " ") for x in told["symbol"].to_pylist()]

    def _symbols(self, text: str) -> np.ndarray:
        parts = [np.frombuffer(text[lo:lo + STRETCH].encode("utf-32-le"), "<u4") for lo in range(0, len(text), STRETCH)]
        return np.concatenate([np.zeros(0, np.uint8), *(self.table[np.minimum(p, len(self.table) - 1)] for p in parts)])

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The folded texts; null ones as empty ones. About ``STRETCH`` bytes are folded at a time, and a longer text alone."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        folded, lo = [pa.array([], pa.large_string())], 0
        while lo < len(texts):
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, "right")), lo + 1)
            folded.append(self._fold(texts[lo:hi]))
            lo = hi
        return pa.concat_arrays(folded)

    def _fold(self, texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        for char, lower in self.several.items():
            rows = [t.replace(char, lower) for t in rows]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        end = np.cumsum(size)
        symbols = np.insert(self._symbols("".join(rows)), np.stack([end - size, end], 1).ravel(), ord(" "))
        begin = end - size + 2 * np.arange(len(rows))
        kept = symbols != ord(" ")
        kept[1:] |= kept[:-1]  # of a run of blanks the first stays
        kept[begin] = True
        places = np.concatenate([[0], np.cumsum(np.add.reduceat(kept, begin, dtype=np.int64))])
        return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(places), pa.py_buffer(symbols[kept]))


_FOLDING: list[Folding] = []


def folding(spark: SparkSession) -> Folding:
    """The table, made once."""
    if not _FOLDING:
        _FOLDING.append(Folding(spark))
    return _FOLDING[0]


def count_trigrams(folded: pa.Array) -> np.ndarray:
    """How often each trigram number occurs in folded texts, ``STRETCH`` bytes at a time."""
    folded = folded.cast(pa.large_string())
    total = np.zeros(CELLS + 1, np.int64)
    if len(folded):
        _, places, letters = folded.buffers()
        bounds = np.frombuffer(places, np.int64)[folded.offset:folded.offset + len(folded) + 1]
        data = np.frombuffer(letters or b"", np.uint8)[bounds[0]:bounds[-1]]
        ends = bounds[1:] - bounds[0]
        across = np.unique(np.concatenate([ends - 2, ends - 1]))  # where trigrams begin that no text holds
        for lo in range(0, len(data) - 2, STRETCH):
            code = data[lo:lo + STRETCH + 2].astype(np.int32) & 31
            number = code[:-2] << 10 | code[1:-1] << 5 | code[2:]
            number[across[slice(*np.searchsorted(across, [lo, lo + len(number)]))] - lo] = CELLS
            total += np.bincount(number, minlength=CELLS + 1)
    return total[:CELLS]


def train_profile(documents: DataFrame, languages: Sequence[str], text: str = "text",
                  label: str = "lang") -> DataFrame:
    """Smoothed log-probability of each trigram in each language.

    Texts are folded and counted in Arrow batches; a task sends one row a trigram, so what is
    shuffled is bounded by the alphabet too.
    """
    fold = folding(documents.sparkSession)
    letters = {i: chr(i | 96) for i in (*range(1, 27), 30)} | {0: " "}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            for j, lang in enumerate(languages):
                total[j] += count_trigrams(fold(batch.column(1).filter(pc.equal(batch.column(0), lang))))
        met = np.flatnonzero(total.any(axis=0))
        names = ["".join(letters[i] for i in (n >> 10, n >> 5 & 31, n & 31)) for n in met.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array(row[met]) for row in total)], ["trigram", *(f"n_{x}" for x in languages)])

    labelled = documents.filter(F.col(label).isin(*languages)).select(F.col(label).cast("string"), F.col(text).cast("string").alias("text"))
    counts = (
        labelled.filter(F.col("text").isNotNull())
        .mapInArrow(count, "trigram string, " + ", ".join(f"`n_{x}` bigint" for x in languages))
        .groupBy("trigram").agg(*[F.sum(f"`n_{lang}`").alias(f"n_{lang}") for lang in languages])
    )
    totals = counts.agg(
        F.struct(*[F.sum(f"n_{lang}").alias(lang) for lang in languages]).alias("totals")).scalar()

    def log_probability(lang: str) -> Column:
        p = (F.col(f"n_{lang}") + 1) / (totals[lang] + ALPHABET_CUBED)
        return F.round(F.ln(p) * SCALE).cast("long").alias(score_column(lang))

    return counts.select("trigram", *[log_probability(lang) for lang in languages])


def dense_profile(profile: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """The profile as a table with a row per trigram number and a column per language.

    At most ``ALPHABET_CUBED`` rows are collected. Rows without a trigram hold 0, which no logarithm
    of a probability is.
    """
    columns = [score_column(lang) for lang in languages]
    dense = np.zeros((CELLS, len(columns)), np.int64)
    for r in profile.select("trigram", *columns).collect():
        one, two, three = r["trigram"].encode()
        dense[(one & 31) << 10 | (two & 31) << 5 | three & 31] = [r[c] for c in columns]
    return dense


def sums(folded: pa.Array, dense: np.ndarray) -> np.ndarray:
    """The summed log-probabilities of folded texts, a row a text.

    A folded text has one byte a symbol, and five bits of it tell the symbols apart. Three of them are a
    trigram's number. Running sums give each text's sum as a difference. They are taken over ``STRETCH``
    bytes at a time and go on across texts, so memory does not depend on how much text a batch holds.
    """
    folded = pc.fill_null(folded, "").cast(pa.large_string())
    _, places, letters = folded.buffers()
    bounds = np.frombuffer(places, np.int64)[folded.offset:folded.offset + len(folded) + 1] if len(folded) else np.zeros(1, np.int64)
    data = np.frombuffer(letters or b"", np.uint8)[bounds[0]:bounds[-1]]
    begins, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    last = np.maximum(ends - 2, begins)  # a text's trigrams begin before this place
    # texts lie in order, so begins and last are sorted
    out = np.zeros((len(folded), dense.shape[1]), np.int64)
    before = np.zeros(dense.shape[1], np.int64)
    for lo in range(0, len(data) + 1, STRETCH):
        size = min(STRETCH, len(data) - lo)
        code = data[lo:lo + size + 2].astype(np.int32) & 31
        number = code[:-2] << 10 | code[1:-1] << 5 | code[2:]
        here = [slice(*np.searchsorted(at, [lo, lo + STRETCH])) for at in (last, begins)]
        for j in range(dense.shape[1]):
            total = np.full(size + 1, before[j])
            np.cumsum(dense[:, j][number], out=total[1:len(number) + 1])
            total[1:len(number) + 1] += before[j]
            total[len(number) + 1:] = total[len(number)]
            out[here[0], j] += total[last[here[0]] - lo]
            out[here[1], j] -= total[begins[here[1]] - lo]
            before[j] = total[size]
    return out


def scores(texts: Column, profile: DataFrame, languages: Sequence[str]) -> Column:
    """Each text's summed log-probability in each language, for an array of texts: an array of structs.

    Trigrams that the training corpus never showed add nothing; a text without a known one
    gets NULLs. Texts are folded and summed in Arrow batches.
    """
    dense, fold = dense_profile(profile, languages), folding(profile.sparkSession)
    columns = [score_column(lang) for lang in languages]

    @F.arrow_udf("array<struct<" + ",".join(f"{c}:bigint" for c in columns) + ">>")
    def summed(lists: pa.Array) -> pa.Array:
        found = sums(fold(lists.flatten()), dense)
        known = found[:, 0] != 0
        fields = [pa.array(found[:, j], pa.int64(), mask=~known) for j in range(len(columns))]
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(fields, names=columns))

    return summed(texts)


def best(sums: Column, languages: Sequence[str]) -> Column:
    """The language with the highest sum; equal sums go to the later name."""
    top = F.array_max(F.array(*[
        F.struct(sums[score_column(lang)].alias("score"), F.lit(lang).alias("lang")) for lang in languages]))
    return F.when(sums[score_column(languages[0])].isNotNull(), top["lang"])


def score_texts(df: DataFrame, profile: DataFrame, languages: Sequence[str],
                keys: Sequence[str], text: str) -> DataFrame:
    """Per row its keys, its text's summed log-probability in each language, and the best one.

    See :func:`scores`. Narrow: no row meets another one.
    """
    scored = df.select(*keys, scores(F.array(text), profile, languages).alias("_s")).select(*keys, F.col("_s")[0].alias("_s"))
    return scored.select(*keys, "_s.*", best(F.col("_s"), languages).alias("best_lang"))


def probability(sums: Column, language: str, languages: Sequence[str]) -> Column:
    """Softmax share of one language in the summed log-probabilities."""
    own = sums[score_column(language)]
    odds = [F.exp(F.least((sums[score_column(lang)] - own) / SCALE, F.lit(700.0)))
            for lang in languages]
    total = odds[0]
    for o in odds[1:]:
        total = total + o
    return F.lit(1.0) / total


def _lines(readmes: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The kept lines of each cleaned README."""
    cleaned = readmes.select(*keys, fx.clean_readme(text).alias("_cleaned"))
    return cleaned.withColumn("_lines", fx.text_lines("_cleaned"))


def line_language(readmes: DataFrame, profile: DataFrame, languages: Sequence[str],
                  keys: Sequence[str] = ("full_name",), text: str = "content") -> DataFrame:
    """Best language of each kept README line; NULL where none could be told."""
    scored = _lines(readmes, keys, text).select(*keys, scores(F.col("_lines"), profile, languages).alias("_scored"))
    # an inner generator would have Spark ask for the size of the array, and score the lines twice for it
    lines = scored.select(*keys, F.posexplode_outer("_scored").alias("line_no", "_s")).filter(F.col("line_no").isNotNull())
    return lines.select(*keys, "line_no", best(F.col("_s"), languages).alias("line_lang"))


def english_share(readmes: DataFrame, profile: DataFrame, languages: Sequence[str],
                  keys: Sequence[str] = ("full_name",), text: str = "content",
                  english: str = "en") -> DataFrame:
    """Share of English among the kept lines of each README.

    Lines no language could be told for stay in the denominator. A README without a kept
    line gets the probability that its whole text is English, or NULL if that is below
    0.1 or nothing in it is known. Everything is computed within the README's row.
    """
    whole = F.coalesce(F.size("_lines"), F.lit(0)) == 0
    units = F.when(whole, F.array("_cleaned")).otherwise(F.col("_lines"))
    scored = _lines(readmes, keys, text).select(*keys, whole.alias("_whole"), scores(units, profile, languages).alias("_scored"))
    told = scored.select(
        *keys, "_whole", F.size("_scored").alias("_n"),
        F.size(F.filter("_scored", lambda s: F.coalesce(best(s, languages) == english, F.lit(False)))).alias("_n_english"),
        F.when(F.col("_whole"), probability(F.col("_scored")[0], english, languages)).alias("_p"))
    share = F.when(~F.col("_whole"), F.col("_n_english") / F.col("_n")).otherwise(F.when(F.col("_p") > MIN_PROBABILITY, F.col("_p")))
    return told.select(*keys, share.alias("readme_lang_conf"))


def readme_language(readmes: DataFrame, profile: DataFrame, languages: Sequence[str],
                    threshold: float = tx.ENGLISH_THRESHOLD) -> DataFrame:
    """``full_name, readme_lang, readme_lang_conf`` as the language gate wants them."""
    return _named(english_share(readmes, profile, languages), threshold)


def corpus_readme_language(files: DataFrame, profile: DataFrame, languages: Sequence[str],
                           threshold: float = tx.ENGLISH_THRESHOLD, among: DataFrame | None = None) -> DataFrame:
    """:func:`readme_language` of the README that counts for each repository.

    Every README variant is scored where it is read, and the one that counts is picked among
    the scores, on paths alone; so no README is shuffled. With ``among`` (``full_name``) only
    READMEs of these repositories are scored. Of ``files`` stored in buckets of ``full_name``
    (``session.bucketed``) that moves no README either, however many names there are.
    """
    keys = ("full_name", "readme_rank")
    readmes = readme_files(files)
    if among is not None:
        readmes = readmes.join(among.select("full_name"), "full_name", "left_semi")
    shares = english_share(readmes, profile, languages, keys)
    picked = shares.join(chosen_readme(files), list(keys), "left_semi")
    return _named(picked, threshold)


def _named(shares: DataFrame, threshold: float) -> DataFrame:
    return shares.select(
        "full_name", fx.readme_lang("readme_lang_conf", threshold).alias("readme_lang"),
        "readme_lang_conf")
