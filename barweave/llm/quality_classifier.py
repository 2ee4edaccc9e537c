"""Quality classifier: gradient-boosted trees (``boosting``) over statistics of whole documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import id_and_text, map_texts, mix, word_hashes

#: At most so many labelled documents are learned from, those with the smallest hashes of their ids.
MAX_TRAINING_DOCS = 20_000
#: A score from here on predicts label 1.
CUT = 0.7
#: Rows whose id has this remainder of crc32 by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digits", "spaces", "other_ascii", "beyond_ascii", "control", "symbols",
    "exclamations", "bars", "stops", "entropy", "word_length", "word_length_deviation", "longest_word", "distinct_words",
    "commonest_word", "repeated_neighbours", "repeated_windows", "capital_words", "initial_capitals", "odd_endings",
    "words_without_letters", "words_a_line", "repeated_lines", "odd_lines", "shouting_lines",
)

_BYTES = np.arange(256)


def _is(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER, _DIGIT = (_is(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_SPACE = _is(b" \t\n\x0b\x0c\r")
_SYMBOL = _is(b"#*$%&<>@^~=+{}[]\\")
_STOP = _is(b".,;:?'\"()-")
_BEYOND = _BYTES >= 128
_CONTROL = (_BYTES < 32) & ~_SPACE
_LETTER = _UPPER | _LOWER | _BEYOND
_ODD_END = ~(_LETTER | _DIGIT | _STOP | _SPACE)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, ~(_LETTER | _DIGIT | _SPACE | _CONTROL), _BEYOND, _CONTROL, _SYMBOL, _is(b"!"), _is(b"|"), _STOP]).astype(float)


def statistics(text: str | None) -> np.ndarray:
    """The STATISTICS of a whole text, all finite; zeros for an empty one."""
    data = (text or "").encode()
    out = np.zeros(len(STATISTICS))
    if not data:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    share = counts / len(raw)
    starts, ends, hashes = word_hashes(data)
    n = len(starts)
    seen = share[share > 0]
    out[:14] = [np.log1p(len(raw)), np.log1p(n), *(_CLASSES @ share), -float(seen @ np.log2(seen))]
    if not n:
        return out

    def held(table: np.ndarray) -> np.ndarray:
        """How many bytes of a class, which has no white space, each word has."""
        return np.add.reduceat(table[raw], starts, dtype=np.int64)

    lengths = ends - starts
    letters, capitals = held(_LETTER), held(_UPPER)
    odd, shouted = _ODD_END[raw[ends - 1]], (capitals == letters) & (letters > 1)
    ordered = np.sort(hashes)
    repeats = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))), append=n)
    windows = mix(hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]) if n > 2 else hashes[:0]
    line_of = np.searchsorted(np.flatnonzero(raw == 10), starts)
    first = np.flatnonzero(np.diff(line_of, prepend=-1))
    in_line = np.diff(first, append=n)
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    out[14:] = [
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        # Vocabularies grow more slowly than texts: compared on a logarithmic scale.
        np.log1p(len(repeats)) / np.log1p(n),
        repeats.max() / n,
        np.count_nonzero(hashes[1:] == hashes[:-1]) / n,
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0,
        np.count_nonzero(shouted) / n,
        np.count_nonzero(_UPPER[raw[starts]]) / n,
        np.count_nonzero(odd) / n,
        np.count_nonzero(letters == 0) / n,
        np.log1p(n / len(in_line)),
        1 - len(set(filled)) / len(filled) if filled else 0.0,
        (np.add.reduceat(odd, first, dtype=np.int64) / in_line).max(),
        np.mean(np.add.reduceat(shouted, first, dtype=np.int64) / in_line > 0.5),
    ]
    return out


def fold(doc_id: Column) -> Column:
    """The remainder that tells held-out rows; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def training_ids(labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> DataFrame:
    """(doc_id, label) that may be learned from: not held out, labelled 0 or 1 and not both; at most ``max_docs``. Where
    there are more, a bound on a hash of the id chooses them, so that no task sorts or sends more than its share."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    ids = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").select("doc_id", "label")
    n = ids.count()
    if n <= max_docs:
        return ids
    parts = 1 << 30
    # A little under the bound: the hash decides on each id for itself.
    share = int(parts * max(max_docs - 4 * max_docs**0.5, 0) / n)
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).limit(max_docs)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS, **settings) -> Trees:
    """Trees from the labelled documents that are not held out. Tasks make the statistics; what comes to the driver is a
    row of numbers for each of at most ``max_docs`` documents. Of rows that share an id one text counts, by its
    hash."""
    chosen = F.broadcast(training_ids(labels, max_docs))  # bounded by max_docs rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    made = map_texts(
        rows.select("doc_id", "label", F.xxhash64("text").alias("version"), "text"),
        "numbers array<double>",
        lambda: lambda texts: [(statistics(t).tolist(),) for t in texts],
        keep=("doc_id", "label", "version"),
    )
    best = made.groupBy("doc_id").agg(F.min_by(F.struct("label", "numbers"), "version").alias("x"))
    found = best.select("doc_id", "x.label", "x.numbers").toPandas().sort_values("doc_id")
    numbers = np.array(found["numbers"].tolist(), dtype=float).reshape(len(found), len(STATISTICS))
    return fit(numbers, found["label"].to_numpy(dtype=float), **settings)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, max_docs: int = MAX_TRAINING_DOCS, **settings) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from ``cut`` on).

    The score depends on the text alone and on the model, so equal texts get equal scores. A null text counts as empty,
    which is scored like any other; texts of any length are read whole; a null id is not held out; repeated rows each
    give a row; other columns are ignored; an empty table gives no rows. Contradicting and null labels are not learned
    from. With no labels, or of one class, every score is the smoothed share of label 1. No shuffle of texts."""
    rows = id_and_text(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, max_docs, **settings))

    def judge():
        def one(texts):
            if not texts:
                return []
            scores = model.value.probabilities(np.stack([statistics(t) for t in texts]))
            return [(float(s), int(s >= cut)) for s in scores]

        return one

    source = rows.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
    return map_texts(source, "score double, predicted int", judge, keep=("doc_id", "held_out"))
