"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, id_and_text, map_texts, mix, word_hashes
from .repeats import gram_hashes

#: Buckets of the two models: runs of GRAM bytes, and words.
BUCKET_BITS, WORD_BITS = 16, 17
GRAM = 3
#: At most so many labelled documents make the target model (smallest hashes of their ids first).
MAX_TARGET_DOCS = 20_000
#: What is added to the observed and to the expected count of a bucket: a bucket that should hardly occur in the target
#: says little, whatever the size of the tables.
GRAM_PRIOR, WORD_PRIOR = 20.0, 1.0
#: Texts whose mean log ratio per n-gram is below this are rejected: noise.
THRESHOLD = -0.3
#: Words with a log ratio below the first value are distrusted (the target lacks them although it should have a dozen);
#: texts in which they take more than the second value per word are rejected: abuse.
DISTRUSTED, WORD_THRESHOLD = -2.5, -0.03

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = b" \t\n\x0b\x0c\r"


def ngram_buckets(data: bytes) -> np.ndarray:
    """Buckets of the runs of GRAM bytes of a text (of the whole text if it is shorter). Bytes rather than words:
    a target of a few documents then knows nearly all n-grams of clean text."""
    if not data:
        return np.zeros(0, dtype=np.int64)
    codes = byte_codes(data)
    return (gram_hashes(codes, min(GRAM, len(codes))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def base_counts(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    chars = int(np.count_nonzero(~space & ((raw & 0xC0) != 0x80)))
    symbols = int(np.count_nonzero(_SYMBOL[raw]))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    repeated = 0
    if len(hashes) > 3:
        k = np.uint64(0x9E3779B97F4A7C15)
        windows = mix(mix(hashes[:-2] * k + hashes[1:-1]) * k + hashes[2:])
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[inverse] > 1)
        covered = np.zeros(len(hashes), dtype=bool)
        for shift in range(3):
            covered[twice + shift] = True
        repeated = int(np.count_nonzero(covered))
    return chars, symbols, len(lines) - len(set(lines)), repeated


def target_documents(labels: DataFrame, max_docs: int = MAX_TARGET_DOCS) -> DataFrame:
    """Ids of the trusted documents: labelled good and not toxic, at most ``max_docs``."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float) -> np.ndarray:
    """log of how often the target has each bucket to how often it would if it were like the raw corpus."""
    expected = target.sum() * raw / max(raw.sum(), 1)
    return np.log((target + prior) / (expected + prior))


def ngram_log_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target_docs: int = MAX_TARGET_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the buckets of n-grams, and those of words where they are distrusted (0 elsewhere). Raw counts
    cover every document. Each task adds up its own counts; the sums of the buckets, 2**16 + 2**17 whatever the input,
    come to the driver."""
    import pyarrow as pa

    trusted = F.broadcast(target_documents(labels, max_target_docs).withColumn("trusted", F.lit(True)))  # bounded by max_target_docs rows
    rows = id_and_text(docs, id_col, text_col).join(trusted, "doc_id", "left").select("text", "trusted")
    grams, size = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + (1 << WORD_BITS)

    def count(batches):
        sums = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                for found, first in ((ngram_buckets(data), 0), (word_buckets(word_hashes(data)[2]), grams)):
                    np.add.at(sums[0], found + first, 1)
                    if good:
                        np.add.at(sums[1], found + first, 1)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, size))
    if len(sums):
        counts[:, sums["bucket"].to_numpy()] = sums[["raw", "target"]].to_numpy().T
    words = log_ratios(counts[0, grams:], counts[1, grams:], WORD_PRIOR)
    return log_ratios(counts[0, :grams], counts[1, :grams], GRAM_PRIOR), np.where(words < DISTRUSTED, words, 0.0)


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, word_threshold: float = WORD_THRESHOLD, id_col: str = "doc_id", text_col: str = "text", max_target_docs: int = MAX_TARGET_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, word_score.

    ``score`` is the mean log ratio over the n-grams of the whole text, ``word_score`` that over its words, where only
    distrusted ones count; ``kept`` is false if the base rules fail or a score is below its threshold. The same text
    always gets the same verdict under one model. A null or wordless text has counts 0, scores 0 and fails by its
    length; texts of any length are judged whole. Without any trusted label all scores are 0. Repeated rows each give
    a row; a null id is kept; other columns are ignored but for those in ``keep``; an empty table gives no rows. No
    shuffle of texts."""
    ratios = docs.sparkSession.sparkContext.broadcast(ngram_log_ratio(docs, labels, id_col, text_col, max_target_docs))

    def judge():
        gram_weights, word_weights = ratios.value

        def one(texts):
            rows = []
            for text in texts:
                data = (text or "").encode()
                starts, ends, hashes = word_hashes(data)
                n = len(starts)
                counts = base_counts(data, starts, ends, hashes)
                score = float(gram_weights[ngram_buckets(data)].mean()) if n else 0.0
                word_score = float(word_weights[word_buckets(hashes)].mean()) if n else 0.0
                failed = n < 50 or 100 * counts[3] > 50 * n
                rows.append((n, *counts, failed, not failed and score >= threshold and word_score >= word_threshold, score, word_score))
            return rows

        return one

    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double, word_score double"
    if keep:
        source = docs.select(*keep)
        return map_texts(source, columns, judge, keep=keep, text=text_col)
    return map_texts(id_and_text(docs, id_col, text_col), columns, judge)
