"""Quality rules and a hashed n-gram log-likelihood ratio.

1. Word counts of every whole text decide the base rules.
2. Words and pairs of words of every text are hashed to ``2**bits`` buckets and counted:
   over the whole corpus, and over trusted documents. Both become multinomials, the
   trusted one with the corpus as its prior, and log(trusted / corpus) is a weight for
   each bucket.
3. A text's score is the mean weight of its n-grams, so long and short texts compare.
4. Trusted documents that the weights were not fitted on are scored too. The threshold
   stands ``spread`` standard deviations of theirs below their mean, and every text is
   judged by it alike.

The trusted side is every row that the labels call good, by a hash of its id one half for the
weights and one for the threshold; everything else covers all rows. Counts are summed within a task before the
shuffle, and only one number for each bucket comes to the driver. Only texts of trusted documents, and the few
that a filter of bits takes for such, are shuffled, once each, to meet their labels.

Defined results: null, empty or blank texts have no words and fail the base rules; a null
``doc_id`` is kept as null and is never trusted; equal rows give equal result rows; with
no trusted document every weight is 0 and the base rules alone decide; other columns are
ignored, and ``keep_good`` passes them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, give_back, in_slices, likely_in, packed, text_of, unpacked
from evoframe.llm._words import mixed, word_hashes, words_of_each

BITS = 14
PRIOR = 0.1  # how much the corpus counts as against the trusted documents
SPREAD = 3.5
LEAST_WORDS = 50
REPEATED, OF = 50, 100  # base_failed where OF * n_repeat_words > REPEATED * n_words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: For each byte: 1 white space, 2 a symbol, 3 a later byte of a code point, else 0.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 1
_KINDS[list(b"#*$%&|<>")] = 2
_KINDS[0x80:0xC0] = 3


def read_words(text: str) -> tuple[bytes, np.ndarray]:
    """The text's bytes and the hashes of its words."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw, word_hashes(raw)


def read_all(texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
    """``read_words`` of many texts at once."""
    raws = [text.encode("utf-8", "surrogatepass") for text in texts]
    return list(zip(raws, words_of_each(raws)))


def base_counts(raw: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """The counts named in ``BASE``."""
    n = len(hashes)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=4)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > 3:
        windows = mixed(mixed(mixed(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(n, bool)
            for at in (order[1:][same], order[:-1][same]):
                for k in range(3):
                    again[at + k] = True
            repeated = int(again.sum())
    return n, int(kinds[0] + kinds[2]), int(kinds[2]), len(lines) - len(set(lines)), repeated


def ngram_buckets(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bucket of every word, and of every pair of neighbouring words."""
    grams = mixed(hashes)
    if len(hashes) > 1:
        grams = np.concatenate([grams, mixed(grams[:-1] + hashes[1:])])
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``good_id, fit``: all ids that the labels call good, and whether weights are fitted on it."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    return good.withColumn("fit", F.pmod(F.hash("good_id"), F.lit(2)) == 0)


def trusted_texts(docs: DataFrame, labels: DataFrame, fit: bool) -> DataFrame:
    """``text`` of the trusted documents that the weights are fitted on, or of those that they are not."""
    rows = documents_of(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    good = trusted_ids(labels).where(F.col("fit") == fit).select("good_id")
    return likely_in(rows, "doc_id", good, "good_id").join(good, F.col("doc_id") == F.col("good_id")).select("text")


def bucket_counts(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """``bucket, n`` over all n-grams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in in_slices(batches):
            grams = [ngram_buckets(hashes, bits) for _, hashes in read_all(batch.column("text").to_pylist())]
            total += np.bincount(np.concatenate(grams), minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, total[some])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_weights(counts: DataFrame, trusted_counts: DataFrame, bits: int = BITS, prior: float = PRIOR) -> np.ndarray:
    """log(trusted / corpus) for each bucket; at most ``2**bits`` rows of either come to the driver."""
    total, trusted = np.zeros(1 << bits), np.zeros(1 << bits)
    for numbers, rows in ((total, counts), (trusted, trusted_counts)):
        for row in rows.collect():
            numbers[row.bucket] = row.n
    if not trusted.any():
        return np.zeros(1 << bits)
    corpus = (total + 1) / (total.sum() + len(total))
    share = prior * trusted.sum()
    return np.log((trusted + share * corpus) / (trusted.sum() + share) / corpus)


def quality_column(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> Column:
    """A struct of the base counts and ``score`` (null without words) for ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers
    schema = ", ".join(f"{name} long" for name in BASE) + ", score double"

    def judge(texts: pd.Series) -> pd.DataFrame:
        counts, scores = [], []
        for at in range(0, len(texts), 500):
            for raw, hashes in read_all(texts.iloc[at : at + 500].tolist()):
                counts.append(base_counts(raw, hashes))
                scores.append(float(shared.value[ngram_buckets(hashes, bits)].mean()) if len(hashes) else None)
        give_back()
        return pd.DataFrame(counts, columns=list(BASE)).assign(score=pd.array(scores, "Float64"))

    # not deterministic, so that the optimizer keeps it to one evaluation for each row
    return F.pandas_udf(judge, schema).asNondeterministic()(text_of())


def fitted(docs: DataFrame, labels: DataFrame, bits: int, prior: float, spread: float) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the threshold."""
    rows = documents_of(docs, "doc_id", "text").select(text_of().alias("text"))
    weights = bucket_weights(bucket_counts(rows, bits), bucket_counts(trusted_texts(docs, labels, True), bits), bits, prior)
    good = trusted_texts(docs, labels, False).select(quality_column(docs, weights, bits).alias("found")).where("found.score IS NOT NULL")
    seen = good.agg(F.avg("found.score").alias("mean"), F.stddev_pop("found.score").alias("sd")).first()
    return weights, -math.inf if seen["mean"] is None else seen["mean"] - spread * seen["sd"]


def _judged(rows: DataFrame, docs: DataFrame, labels: DataFrame, bits: int, prior: float, spread: float) -> tuple[DataFrame, Column, Column, float]:
    """``rows``, which have ``text``, with ``found``; whether the base rules fail, whether a row is kept, and the threshold."""
    weights, threshold = fitted(docs, labels, bits, prior, spread)
    found = rows.withColumn("found", quality_column(docs, weights, bits))
    q = F.col("found")
    failed = (q.n_words < LEAST_WORDS) | (OF * q.n_repeat_words > REPEATED * q.n_words)
    return found, failed, ~failed & (q.score >= threshold), threshold


def judge_quality(
    docs: DataFrame, labels: DataFrame, bits: int = BITS, prior: float = PRIOR, spread: float = SPREAD
) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed, kept, score, threshold`` for each row of ``docs``."""
    docs = documents_of(docs, "doc_id", "text")
    found, failed, kept, threshold = _judged(docs, docs, labels, bits, prior, spread)
    counts = [F.col(f"found.{name}").alias(name) for name in BASE]
    more = [F.col("found.score").alias("score"), F.lit(threshold).alias("threshold")]
    return found.select("doc_id", *counts, failed.alias("base_failed"), kept.alias("kept"), *more)


def keep_good(
    docs: DataFrame, labels: DataFrame, bits: int = BITS, prior: float = PRIOR, spread: float = SPREAD
) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with the columns they have, whatever their names."""
    found, _, kept, _ = _judged(packed(docs, "text"), docs, labels, bits, prior, spread)
    return unpacked(found.where(kept), docs.columns)
