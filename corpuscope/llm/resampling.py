"""Importance resampling towards a target distribution, on hashed word n-grams.

Documents and target texts are bags of hashed features: words and pairs of neighbouring words.
A bucket's gain is the log ratio of its smoothed shares in the target and in the documents; a
document weighs the mean gain of its features, and Gumbel noise on top of the weights turns the
highest scores into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import Kept, numbered

#: Buckets of the hashed features, words from which a document may be drawn, percent of those
#: that are drawn, and the seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Runs between words: everything in ASCII but digits and (lower-cased) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Length in bytes up to which a word's effect on a checksum is tabulated.
TABULATED = 64

_SHIFTS: dict[int, np.ndarray] = {}


def _shift(length: int) -> np.ndarray:
    """What ``length`` zero bytes do to a checksum, by each of its four bytes (the map is linear)."""
    if length not in _SHIFTS:
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        _SHIFTS[length] = np.array([[zlib.crc32(zeros, v << (8 * j)) ^ none for v in range(256)] for j in range(4)], np.uint32)
    return _SHIFTS[length]


def pair_checksums(words: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CRC-32 of ``words[first] + b" " + words[second]``, from one checksum a word.

    The checksum of a joined text is that of its beginning, carried over as many zero bytes as the rest
    has, combined with that of the rest.
    """
    alone = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in alone.tolist()], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(first), np.uint32)
    lengths = size[second]
    for length in np.unique(lengths[lengths <= TABULATED]).tolist():
        at = np.flatnonzero(lengths == length)
        begin, tables = spaced[first[at]], _shift(length)
        moved = tables[0][begin & 0xFF]
        for j in range(1, 4):
            moved ^= tables[j][(begin >> np.uint32(8 * j)) & np.uint32(0xFF)]
        out[at] = moved ^ alone[second[at]]
    for i in np.flatnonzero(lengths > TABULATED).tolist():
        out[i] = zlib.crc32(words[second[i]], int(spaced[first[i]]))
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, and the owners and buckets of all features.

    Texts are split by Arrow's kernels and the words encoded by one dictionary. Pairs are shifted
    indices of that dictionary; only distinct words and distinct pairs are hashed. Null: no words.
    """
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    parts = pc.split_pattern_regex(low, pattern=BETWEEN)
    encoded = pc.list_flatten(parts).dictionary_encode()
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    real = np.array([len(w) > 0 for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
    codes, owner = codes[real], owner[real]
    n_words = np.bincount(owner, minlength=len(texts))
    single = np.array([zlib.crc32(w) for w in words], np.uint32)[codes] if len(codes) else np.zeros(0, np.uint32)
    beside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = pa.array(codes[beside] * max(len(words), 1) + codes[beside + 1]).dictionary_encode()
    distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
    double = pair_checksums(words, *np.divmod(distinct, max(len(words), 1)))
    double = pa.array(double).take(pairs.indices).to_numpy(zero_copy_only=False) if len(distinct) else double
    buckets = np.concatenate([single, double]).astype(np.int64) % BUCKETS
    return n_words, np.concatenate([owner, owner[beside]]), buckets


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket, over all rows.

    A task adds up its own rows, so a row a bucket and task is shuffled and ``BUCKETS`` reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0))[2], minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

    out = np.zeros(BUCKETS, np.int64)
    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    odds = (target + 1.0) * (corpus.sum() + BUCKETS) / ((corpus + 1.0) * (target.sum() + BUCKETS))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def weigh(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of all features, rounded down."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, owner, buckets = features(batch.column(1))
            n = np.bincount(owner, minlength=len(n_words))
            # whole numbers far below 2**53, so sums of doubles are exact
            total = np.bincount(owner, gain[buckets], len(n_words)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(n, pa.int64()),
                "weight": pa.array(total // np.maximum(n, 1), pa.int64())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel value drawn by a hash of the id (a null id hashes as no text)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``documents`` (``doc_id, text``).

    Of the rows with at least ``LEAST_WORDS`` words, ``percent`` per cent (rounded down) with the
    highest scores are drawn and numbered from 1; the smaller id, then fewer features settle ties, and
    rows without an id come last among equals. All others have no rank.

    Frequencies cover all documents and all of ``target`` (column ``text``). Null and empty texts
    have no features and weigh 0; rows that repeat are drawn one by one. Nothing but the
    ``BUCKETS`` gains is sent to the executors, and ranks come from a range partitioned sort.
    """
    kept = Kept(documents.sparkSession, "resampling")
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scored = kept.write(weigh(documents, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    drawn = percent * able.count() // 100
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")
    ranked = numbered(kept, able, "rank", *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    columns = "doc_id", "n_features", "weight", "score", "rank"
    return ranked.select(*columns).unionByName(rest.select(*columns))
