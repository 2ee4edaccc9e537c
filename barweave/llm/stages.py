"""The operators as stages of a corpus pipeline: documents in, documents out.

What holds for all stages: documents have ``doc_id`` and ``text``; all other columns, whatever their names, are handed
on as they are. A null text counts as empty, texts of any length are taken whole, an empty table gives an empty table.
Rows are told apart by id and text together, so rows that share an id, or have none, are judged each for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, fresh, row_key, stored
from .decontaminate import contaminated_rows
from .pii import mask_personal_data
from .quality import quality_verdicts
from .sentencepiece_codec import sentencepiece_encode
from .simhash import near_duplicate_rows


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the quality rules keep; nulls, empty and short texts fail by their length, repeated rows share
    a verdict."""
    names = [f"_{i}" for i in range(len(docs.columns))]  # clash with nothing that the operator adds
    known = dict(zip(map(str.lower, docs.columns), names))
    judged = quality_verdicts(docs.toDF(*names), labels, id_col=known["doc_id"], text_col=known["text"], keep=tuple(names))
    return judged.where("kept").select(*names).toDF(*docs.columns)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, a Jaccard similarity of 0.8 or more): the one with
    the smallest id (among those that share it, one text by its hash); one without an id only where none has one. Of
    repeated rows one stays. Null and empty texts are a group of their own."""
    rows = stored(near_duplicate_rows(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = rows.groupBy("component").agg(F.min(order).alias("x")).select(F.col("x.key").alias("key"))
    counted = stored(rows.groupBy("key").agg(F.count("*").alias("n")).join(best.withColumn("best", F.lit(True)), "key", "left"))
    key, n = fresh("key", docs), fresh("n", docs)
    # Only rows that may go, or that do repeat, are shuffled; all others stay.
    sure, others = apart(docs.withColumn(key, row_key()), key, counted.where("best is null or n > 1").select(F.col("key").alias(key)))
    found = others.join(counted.where("best").select(F.col("key").alias(key), F.col("n").alias(n)), key)
    once, more = found.where(F.col(n) == 1), found.where(F.col(n) > 1).dropDuplicates([key])
    return sure.select(*docs.columns).unionByName(once.select(*docs.columns)).unionByName(more.select(*docs.columns))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a window that is similar to a benchmark item; null and empty texts stay, and so do repeated
    rows that are clean. Nulls and empty texts of the benchmark match nothing."""
    key = fresh("key", docs)
    leaks = contaminated_rows(docs, benchmark).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(leaks, key, "left_anti").select(*docs.columns)


def mask(docs: DataFrame) -> DataFrame:
    """All documents, personal data in them replaced by its kind; ``n_chars``, if there, is the new length. A null text
    stays null; repeated rows are masked alike."""
    return mask_personal_data(docs)


def encode(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, the text decoded from them, and digests of both. A null text has no ids and
    an empty decoded text; repeated rows each give a row."""
    return sentencepiece_encode(docs)
