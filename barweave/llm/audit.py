"""Filter interaction audit: what every filter does at every place in every order, by wide packed counters.

A document is reduced to a mask (which filters it fails) and to flags (which kinds of loss it would be). For each mask
and set of flags one big integer holds an outcome in a 64-bit field for every step of every order; the integers of a
part's documents add up to all its counters at once. No field can overflow, as none exceeds the number of rows."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Outcomes of a step, before those of the kinds of loss.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
#: Above this the orders of all filters are too many: 6! orders of 6 steps are 4,320 rows a part.
MAX_FILTERS = 6


@lru_cache(maxsize=None)
def orders(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


@lru_cache(maxsize=None)
def packed(filters: str, mask: int, flags: int, n_flags: int) -> int:
    """The outcomes of one document at all steps of all orders: a field of 64 bits for each (order, step, outcome),
    1 where it applies. Bit i of ``mask`` says that the i-th filter fails, bit j of ``flags`` that its removal is
    a loss of the j-th kind."""
    fields = np.zeros((len(orders(filters)), len(filters), len(OUTCOMES) + n_flags), dtype="<u8")
    for at, order in enumerate(orders(filters)):
        gone = False
        for step, letter in enumerate(order):
            bit = 1 << filters.index(letter)
            fails = bool(mask & bit)
            removed = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            outcome = (not gone, removed, redundant, mask == bit, *(removed and bool(flags >> j & 1) for j in range(n_flags)))
            fields[at, step] = outcome
    return int.from_bytes(fields.tobytes(), "little")


def unpack(total: int, filters: str, n_flags: int) -> np.ndarray:
    """Counters by order, step and outcome."""
    shape = (len(orders(filters)), len(filters), len(OUTCOMES) + n_flags)
    return np.frombuffer(total.to_bytes(8 * int(np.prod(shape)), "little"), dtype="<u8").reshape(shape).astype(np.int64)


def audit_filters(counted: DataFrame, filters: str, losses: tuple[str, ...] = ()) -> DataFrame:
    """The interaction of filters from (part string, mask int, flags int, n long): ``n`` documents of a part that fail
    the filters of ``mask`` (bit i: the i-th letter of ``filters``) and have the kinds of loss of ``flags`` (bit j: the
    j-th name of ``losses``). Rows may share part, mask and flags.

    Returns a row per part, filter_order (each order of the letters) and step (from 1), zeros included: kept (documents
    left after this step), removed (here), redundant (fail its filter, but were removed before), unique_fails (fail its
    filter alone), a column per loss (removed here and of that kind), shapley (removed by its filter at any step, summed
    over all orders). A null part counts as the empty string, rows without n count nothing; no rows give no rows. A part
    has at most 2**(filters + losses) rows after they are added up, whatever its size."""
    if not 1 <= len(filters) <= MAX_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"1 to {MAX_FILTERS} different filters, not {filters!r}")
    n_flags = len(losses)
    names = [*OUTCOMES, *losses]

    def add(key, pdf):
        import pandas as pd

        total = sum(int(n) * packed(filters, int(m), int(f), n_flags) for m, f, n in zip(pdf["mask"], pdf["flags"], pdf["n"]))
        fields = unpack(total, filters, n_flags)
        letters = np.array([list(order) for order in orders(filters)])
        by_filter = {c: fields[:, :, names.index("removed")][letters == c].sum() for c in filters}
        out = {"part": key[0], "filter_order": np.repeat(orders(filters), len(filters)), "step": np.tile(np.arange(1, len(filters) + 1), len(letters))}
        out |= {name: fields[:, :, i].ravel() for i, name in enumerate(names)}
        return pd.DataFrame(out | {"shapley": [int(by_filter[c]) for c in letters.ravel()]})

    part = F.coalesce(F.col("part"), F.lit("")).alias("part")
    sums = counted.groupBy(part, "mask", "flags").agg(F.sum("n").alias("n")).where("n > 0")
    columns = ", ".join(f"{c} long" for c in [*names, "shapley"])
    return sums.groupBy("part").applyInPandas(add, f"part string, filter_order string, step int, {columns}")


def text_failures(text: Column) -> list[Column]:
    """Filters A to D on a text without nulls: under 100 words; fewer than 80 distinct words in 100; more than one code
    point in ten an ASCII capital; any of ``#$%&*|``."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def masked_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, flags, n) of documents under the filters A to E; E fails where a smaller doc_id has the same text.

    The copies of a text fail A to D alike, so they are first counted by (part, flags), however many they are; E needs
    the least id of a text and how many rows have it. Texts travel as their SHA-256 only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("mask"))
    flag = F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(flag.cast("int").alias("flags"))

    same = ["digest", "mask", "part", "flags"]
    joined = rows.join(flags, "doc_id", "left").withColumn("flags", F.coalesce("flags", F.lit(0)))
    # Rows of one id lie in one partition after the join: no shuffle here.
    by_id = joined.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    texts = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    least = texts.groupBy("digest").agg(F.min("first").alias("least"))
    passing = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct("mask", passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))
    return texts.join(least, "digest").select("part", "flags", F.explode(both).alias("x")).select("part", "x.mask", "flags", "x.n").where("n > 0")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A (under 100 words), B (under 80 distinct words in 100), C (capitals), D (symbols) and E
    (copies of a text with a smaller doc_id) over whole texts, by ``lang``; losses are good_lost (``quality`` = 1) and
    toxic_lost (``toxic`` = 1).

    A null text counts as empty, and all empty texts as copies of the one with the least id; a null lang as the empty
    string; a row without doc_id has no smaller one beside it, is a copy of nothing and has no label; rows that share an
    id are no copies of each other. Of repeated labels any 1 counts, unlabelled documents are no loss. Other columns are
    ignored. No documents give no rows."""
    return audit_filters(masked_documents(docs, labels), "ABCDE", ("good_lost", "toxic_lost"))


#: The same from the definitions: every order against every mask.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
k AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5])::int AS step)),
y AS (SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS bad, translate(before, fails, '') <> before AS gone FROM k, s),
c AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::bigint AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0)::bigint AS redundant, coalesce(sum(n) FILTER (fails = x), 0)::bigint AS unique_fails,
    coalesce(sum(n) FILTER (bad AND NOT gone AND good = 1), 0)::bigint AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic = 1), 0)::bigint AS toxic_lost
  FROM y GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::bigint AS shapley FROM c"""
