"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.
DataFrame functions only.

Items of one length are dealt out on shelves of a bounded number of items. A window of a document that is as long as
the items of a shelf can only be similar to one of them if nearly all of its shingles occur on that shelf; every such
window, wherever it starts and in whatever order its shingles stand, gets a fingerprint. It is looked up among the
shelf's fingerprints by blocks of bits, and what is within the radius is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints are looked up within this many bits. At a similarity of 0.8 a window differs from its item at 9.7 of 64
#: bits with a deviation of 2.9 (a bit flips with a probability of arccos(8/9) / pi), so about 6 pairs in 1,000 right
#: at the threshold lie beyond, and next to none above 0.82.
RADIUS = 17
#: Bits of the blocks. By the pigeonhole principle fingerprints within the radius agree in one of them but for two bits.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
BLOCK_FLIPS = RADIUS // len(BLOCK_BITS)
#: Items to a shelf at most; a random window meets about a quarter of a shelf's items in some block.
SHELF_ITEMS = 256
#: Shingles of items up to this many rows are broadcast (some 40 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def normal_words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words, by position; none of fewer words."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), n - (size - 1)), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]))
    return F.when(n >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """A bit is 1 if set in over half of the hashes."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (a, b) -> a | if(2 * aggregate({hashes}, 0, "
        f"(c, h) -> c + cast(getbit(h, b) as int)) > size({hashes}), shiftleft(1L, b), 0L))"
    )


def block_value(fp: str, block: int) -> str:
    return f"cast(shiftrightunsigned({fp}, {sum(BLOCK_BITS[:block])}) & {(1 << BLOCK_BITS[block]) - 1} as int)"


def block_values(fp: str) -> Column:
    """(block, value) of the blocks of a fingerprint."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.expr(block_value(fp, b)).alias("value")) for b in range(len(BLOCK_BITS))])


def near_values(fp: str) -> Column:
    """(block, value) of all values that differ from those of a fingerprint at BLOCK_FLIPS bits or fewer."""

    def near(block: int) -> Column:
        masks = F.array(*[F.lit(x) for x in range(1 << BLOCK_BITS[block]) if bin(x).count("1") <= BLOCK_FLIPS])
        value = F.expr(block_value(fp, block))
        return F.transform(masks, lambda m: F.struct(F.lit(block).alias("block"), m.bitwiseXOR(value).alias("value")))

    return F.concat(*map(near, range(len(BLOCK_BITS))))


def item_table(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item (a name), item_id, n (words), k (words to a shingle: fewer for items of fewer words), shingles, shelf: items
    of one length, at most about SHELF_ITEMS of them."""
    items = benchmark.select(F.col(id_col).alias("item_id"), normal_words(text_col).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    shingles = F.coalesce(*[F.when(F.least("n", F.lit(size)) == k, shingle_hashes("words", k)) for k in range(1, size + 1)])
    items = items.select("item_id", "n", F.least("n", F.lit(size)).alias("k"), shingles.alias("shingles"))
    shelves = items.groupBy("n").agg(F.ceil(F.count("*") / F.lit(SHELF_ITEMS)).alias("shelves"))
    shelf = F.concat_ws(".", "n", F.pmod(F.xxhash64("shingles"), F.col("shelves")))
    # Items of the same id and shingles are one.
    return items.join(shelves, "n").select("item_id", "n", "k", "shingles", shelf.alias("shelf"), F.xxhash64("item_id", "shingles").alias("item")).dropDuplicates(["item"])


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two lists of shingles, the weights their counts. The lesser counts add up to the shingles in
    common and, for those that repeat in both, what repeats in both; the greater ones to the rest of all. Sets meet by
    hash and repeats are neighbours in a sorted list, so the cost is that of sorting, and a pass for each shingle that
    repeats in both."""
    repeats = [f"get(transform(array(sort_array({x})), s -> array_distinct(filter(s, (h, i) -> i > 0 AND h = get(s, i - 1)))), 0)" for x in (a, b)]
    again = f"aggregate(array_intersect({repeats[0]}, {repeats[1]}), 0, (n, h) -> n + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))) - 1)"
    return F.expr(f"get(transform(array(size(array_intersect({a}, {b})) + {again}), low -> low / (size({a}) + size({b}) - low)), 0)")


def _starts(min_similarity: float) -> Column:
    """Starts of all windows that hold enough of the positions ``at``: a window of w shingles and an item of m have a
    similarity of s only if s / (1 + s) * (m + w) shingles of the window are the item's."""
    least = min_similarity / (1 + min_similarity)
    need = F.greatest(F.ceil(F.lit(least) * (F.col("m") + F.col("w")) - 1e-9).cast("int"), F.lit(1))
    first = F.slice("at", F.lit(1), F.greatest(F.size("at") - need + 1, F.lit(0)))

    def starts(p: Column, i: Column) -> Column:
        low = F.greatest(F.get("at", i + need - 1) - F.col("w") + 1, F.lit(0))
        high = F.least(p, F.col("places") - F.col("w"))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(first, starts)))


def candidate_windows(docs: DataFrame, items: DataFrame, min_similarity: float, size: int) -> DataFrame:
    """(key, doc_id, shelf, start, n_words, shingles): the windows of ``docs`` (doc_id, text) that get a fingerprint.

    Shingles of documents meet the shelves' by equality; what is shuffled are positions of shared shingles. A document
    shorter than an item is one window. Texts are read again only for rows that have such windows."""
    known = stored(items.select("shelf", "n", "k", F.explode("shingles").alias("h")).distinct())
    found = known.agg(F.count("*").alias("rows"), F.collect_set("k").alias("ks")).first()
    keyed = docs.select("doc_id", row_key().alias("key"), "text")
    windows = None
    for k in sorted(found["ks"]) or [size]:
        shelves = known.where(F.col("k") == k).select("h", "shelf", "n")
        if found["rows"] <= BROADCAST_ROWS:
            shelves = F.broadcast(shelves)
        words = keyed.select("doc_id", "key", normal_words("text").alias("words"))
        placed = words.select("doc_id", "key", F.size("words").alias("total"), F.posexplode(shingle_hashes("words", k)).alias("p", "h"))
        hits = placed.join(shelves, "h").groupBy("key", "doc_id", "shelf", "n", "total").agg(F.sort_array(F.collect_set("p")).alias("at"))
        m, places = F.col("n") - k + 1, F.col("total") - k + 1
        sized = hits.select("key", "shelf", "at", places.alias("places"), m.alias("m"), F.least(m, places).alias("w"))
        wanted = sized.select("key", "shelf", "w", _starts(min_similarity).alias("starts")).where(F.size("starts") > 0)
        wanted = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("shelf", "w", "starts")).alias("wanted")))
        texts = keyed.join(wanted, "key").select("doc_id", "key", "wanted", normal_words("text").alias("words"))
        texts = texts.select("doc_id", "key", shingle_hashes("words", k).alias("hashes"), F.explode("wanted").alias("x"))
        made = texts.select("doc_id", "key", "x.shelf", "x.w", "hashes", F.explode("x.starts").alias("start"))
        made = made.select("key", "doc_id", "shelf", "start", (F.col("w") + k - 1).alias("n_words"), F.slice("hashes", F.col("start") + 1, F.col("w")).alias("shingles"))
        windows = made if windows is None else windows.unionByName(made)
    return windows


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, min_similarity: float = SIMILARITY, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``contaminated`` with ``key``, the ``row_key`` of each row, instead of one result for an id."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = stored(item_table(benchmark, item_id_col, item_text_col, size))
    content = F.struct(F.xxhash64("shingles").alias("a"), F.hash("shingles").alias("b"))
    windows = stored(candidate_windows(source, items, min_similarity, size).withColumn("content", content))
    # Copies of a passage make equal windows: each is looked up once.
    different = windows.groupBy("shelf", "content").agg(F.any_value("shingles").alias("shingles")).withColumn("fp", simhash("shingles"))
    index = items.select("item", "shelf", "item_id", F.col("shingles").alias("item_shingles"), simhash("shingles").alias("item_fp"))
    # Written, so that Spark knows its size before it chooses a join.
    probes = stored(index.select("shelf", "item", "item_id", "item_fp", F.explode(near_values("item_fp")).alias("x")).select("shelf", "item", "item_id", "item_fp", "x.block", "x.value"))
    looked = different.select("shelf", "content", "fp", F.explode(block_values("fp")).alias("x")).select("shelf", "content", "fp", "x.block", "x.value")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = looked.join(probes, ["shelf", "block", "value"]).where(hamming <= RADIUS).select("shelf", "content", "item", "item_id", hamming.alias("hamming")).distinct()
    pairs = near.join(different.select("shelf", "content", "shingles"), ["shelf", "content"]).join(index.select("item", "item_shingles"), "item")
    alike = pairs.select("shelf", "content", "item_id", "hamming", similarity("shingles", "item_shingles").alias("similarity")).where(F.col("similarity") >= min_similarity - 1e-12)
    best = F.max_by(F.struct("similarity", "start", "n_words", "hamming"), F.struct(F.col("similarity"), -F.col("start"))).alias("x")
    found = windows.select("key", "doc_id", "shelf", "content", "start", "n_words").join(alike, ["shelf", "content"]).groupBy("key", "doc_id", "item_id").agg(best)
    return found.select(
        "key", "doc_id", "item_id", F.col("x.similarity").alias("similarity"), F.col("x.start").cast("long").alias("start"), F.col("x.n_words").cast("long").alias("n_words"), F.col("x.hamming").cast("long").alias("hamming")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, min_similarity: float = SIMILARITY, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words, hamming): each document and item where some window of the
    document as long as the item (the whole document if that is shorter) has a weighted ``size``-word shingle
    similarity of ``min_similarity`` or more to it; the best window (the first among equals), its start in normal
    words.

    Null and wordless texts match nothing; rows that share an id give one result, the best; a null id is kept; other
    columns are ignored; empty tables give no rows. Texts and items of any length are taken whole. Repeated rows and
    copies of a passage are compared with the items once. A passage may be in any share of the documents: only
    positions are grouped, by document."""
    found = contaminated_rows(docs, benchmark, min_similarity, size, id_col, text_col, item_id_col, item_text_col)
    best = F.max_by(F.struct("similarity", "start", "n_words", "hamming"), F.struct(F.col("similarity"), -F.col("start"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")
