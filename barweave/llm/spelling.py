"""Spelling variant grouping: the words of a corpus, their neighbours at one error, and the form each goes back to.

Neighbours are found with search schemes on bidirectional FM-indexes (``fm_index``). A word that differs from another by
one letter agrees with it exactly in the first or in the second half, so both are sent where words of that half (and
length) are; a shard holds many such groups and one index over their words. A group that is too large for a shard is
split the same way again: half of what may differ has to agree exactly, too."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch, stored

#: Runs of letters, on Latin-1 bytes in ASCII lower case: A-Z, a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"[a-z\xC0-\xFF]+")
MIN_LENGTH, MIN_COUNT = 7, 2
#: A run of a document loses a letter if this divides its hash.
SLIP = 31
#: How much commoner a word's form has to be.
FORM_RATIO = 10
#: Distinct words that a counting task holds before it hands its counts on.
FLUSH_AT = 200_000
#: Rows of a shard, on average, and of a group before it is split again. A shard's memory is some 300 bytes a row.
SHARD_ROWS, MAX_GROUP = 60_000, 20_000


def document_words(doc_id: int | None, text: str | None, min_length: int = MIN_LENGTH, slip: int = SLIP) -> Counter:
    """Words of a text as Latin-1 bytes, with how often they occur; runs lose a letter as the contract of the query
    says (``slip`` 0: none does)."""
    runs = Counter(RUN.findall((text or "").encode("latin-1", "replace").lower()))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words = Counter()
    for run, n in runs.items():
        if len(run) < min_length:
            continue
        if slip:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) < min_length:
                    continue
        words[run] += n
    return words


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` letters and ``min_count`` occurrences. Tasks add up what they
    read and hand on a row per word and flush."""
    import pyarrow as pa

    def count(batches):
        held = Counter()

        def flush():
            words = pa.array([w.decode("latin-1") for w in held], type=pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update(document_words(doc_id, text, min_length, slip))
                if len(held) >= FLUSH_AT:
                    yield flush()
                    held = Counter()
        yield flush()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _with_key(rows: DataFrame) -> DataFrame:
    """Names the group of a row: ``span`` is the length of the group's shorter words, in which [start, end) may differ;
    what comes before it and after it agrees exactly."""
    tail = F.col("span") - F.col("end")
    after = F.expr("substr(word, length(word) - (span - end) + 1)")
    key = F.xxhash64("span", "start", "end", F.expr("substr(word, 1, start)"), F.when(tail > 0, after).otherwise(""))
    return rows.withColumn("key", key)


def _part(span: str, start, end):
    return F.struct(F.expr(span).alias("span"), F.expr(start).alias("start"), F.expr(end).alias("end"))


def neighbour_groups(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(key, word, n, span, start, end): each word in the groups of its own length, where it looks for others, and in those of
    words that are shorter by one, where it is found. All groups but those whose words differ at one place alone are of
    ``max_group`` rows at most."""
    halves = [_part(span, start, end) for span in ("length(word)", "length(word) - 1") for start, end in ((f"({span}) div 2", span), ("0", f"({span}) div 2"))]
    rows = words.select("word", "n", F.explode(F.array(*halves)).alias("x")).select("word", "n", "x.*").where("span > 1")
    open_rows = stored(_with_key(rows.select("word", "n", *(F.col(c).cast("int").alias(c) for c in ("span", "start", "end")))))
    done = None
    while True:
        large = open_rows.where("end - start > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > max_group).select("key")
        large = stored(large)
        if large.isEmpty():
            return open_rows if done is None else done.unionByName(open_rows)
        small = open_rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = "start + (end - start) div 2"
        parts = F.array(_part("span", "start", middle), _part("span", middle, "end"))
        split = open_rows.join(large, "key", "left_semi").select("word", "n", F.explode(parts).alias("x")).select("word", "n", "x.*")
        open_rows = stored(_with_key(split))


def near_words(words: DataFrame, max_group: int = MAX_GROUP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, n, near, near_n) from distinct (word, n): both directions of all pairs of words that differ by exactly
    one letter inserted, deleted or replaced. Words are Latin-1 without U+0000."""
    import pyarrow as pa

    rows = stored(neighbour_groups(words, max_group))
    shards = -(-rows.count() // shard_rows) or 1

    def search(table):
        from .fm_index import WordIndex

        text = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        counts = dict(zip(text, table.column("n").to_pylist()))
        index = WordIndex(list(counts))
        span, start, end = (table.column(c).to_numpy() for c in ("span", "start", "end"))
        lengths = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
        asks = np.flatnonzero(lengths == span)
        order = asks[np.lexsort((end[asks], start[asks], span[asks]))]
        shape = np.stack([span[order], start[order], end[order]], axis=1)
        cuts = np.flatnonzero(np.any(np.diff(shape, axis=0) != 0, axis=1)) + 1
        left, right = [], []
        for same in np.split(order, cuts):
            if not len(same):
                continue
            queries = np.frombuffer(b"".join(text[i] for i in same), dtype=np.uint8).reshape(len(same), -1)
            asked, found = index.near(queries, int(start[same[0]]), int(end[same[0]]))
            left += [text[i] for i in same[asked].tolist()]
            right += [index.words[i] for i in found.tolist()]
        pairs = set(zip(left, right))
        left, right = [u for u, _ in pairs] + [v for _, v in pairs], [v for _, v in pairs] + [u for u, _ in pairs]
        pairs = set(zip(left, right))
        columns = [pa.array([u.decode("latin-1") for u, _ in pairs], type=pa.string()), pa.array([counts[u] for u, _ in pairs], type=pa.int64())]
        columns += [pa.array([v.decode("latin-1") for _, v in pairs], type=pa.string()), pa.array([counts[v] for _, v in pairs], type=pa.int64())]
        return pa.Table.from_arrays(columns, names=["word", "n", "near", "near_n"])

    found = rows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(search, "word string, n long, near string, near_n long")
    # One exchange serves this and all groups by word.
    return found.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), distinct words without cycles: pointers are doubled until none moves, so rounds
    grow with the logarithm of a chain's length."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, slip: int = SLIP, ratio: int = FORM_RATIO, max_group: int = MAX_GROUP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of Latin letters in ASCII lower case, of 7 letters and 2 occurrences at least, after slips (see
    ``document_words``). ``form`` is the near word (one letter inserted, deleted or replaced) that is commonest (ties:
    least in code-point order), if it is at least ``ratio`` times as common as the word; ``root`` follows the forms to the
    last. Null and empty texts have no words; texts and words of any length are taken whole; a null doc_id counts as an
    empty string in the slips; repeated rows count again; other columns are ignored; no words, no rows."""
    if ratio < 2:
        raise ValueError("forms have to be commoner than their words")
    with scratch(docs.sparkSession):
        words = stored(vocabulary(docs, slip=slip))
        best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
        near = near_words(words, max_group, shard_rows).groupBy("word").agg(F.count("*").alias("n_near"), best)
        joined = words.join(near, "word", "left")
        has_form = -F.col("best.minus") >= ratio * F.col("n")
        judged = stored(
            joined.select(
                "word",
                F.when(has_form, F.col("best.near")).alias("form"),
                "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has_form, -F.col("best.minus")).alias("form_n"),
            )
        )
        last = roots(judged.where("form is not null").select("word", "form"))
        out = judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return kept(stored(out))
