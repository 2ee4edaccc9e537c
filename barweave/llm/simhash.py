"""SimHash fingerprints, linked through covering locality-sensitive hashing.

For radius r, every bit position gets a vector of r + 1 bits; each non-zero vector v of r + 1 bits makes a
table whose mask has the positions whose vector has an odd product with v. The vectors of any r positions
lie in a proper subspace, so some v is orthogonal to all of them: a pair that differs at those positions only
agrees on that mask. So every pair within the radius meets in some table.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, commonest, id_and_text, kept, map_texts, mix, row_key, scratch, stored, word_hashes
from .graph import connected_components
from .repeats import gram_hashes

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(rb"[\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of the lower-cased text, repeats included."""
    from xxhash import xxh64_intdigest as h

    found = [w for w in _SPLIT.split((text or "").encode().translate(_LOWER)) if w]
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([h(joined, 42)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def simhash_fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row, as a signed long. Null and wordless texts: 0."""

    def judge():
        return lambda texts: [(fingerprint(shingle_hashes(t, words)),) for t in texts]

    return map_texts(id_and_text(docs, id_col, text_col), "fp long", judge)


def covering_masks(radius: int) -> list[int]:
    """The 2**(radius + 1) - 1 masks, as signed longs. The vectors go round over all non-zero ones, so that
    masks have about half of the bits."""
    width = radius + 1
    vectors = [1 + i % ((1 << width) - 1) for i in range(64)]
    masks = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _long(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame) -> DataFrame:
    """``prints`` (fp), distinct → edges (a, b) that join all fingerprints at 2 or fewer bits.

    Covering tables give the candidates. In a bucket that more than one fingerprint shares, each one goes to
    its midpoints, itself and itself with one bit outside the mask flipped: two fingerprints share a midpoint
    exactly if they differ at 2 or fewer bits, and all that share one hang on the smallest of them. So a bucket
    of m fingerprints makes O(m) rows, never its pairs."""
    masks = covering_masks(2)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    flips = F.create_map(*[x for t, m in enumerate(masks) for x in (F.lit(t), F.array(F.lit(0).cast("long"), *[F.lit(_long(1 << b)) for b in range(64) if not (m >> b) & 1]))])
    points = stored(rows.join(shared, ["t", "key"], "left_semi").select("fp", F.explode(flips[F.col("t")]).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z")).distinct())
    stars = points.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    return points.join(stars, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def simhash_components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable over
    links of 2 or fewer differing bits, itself included).

    A null text counts as empty; empty texts have fingerprint zero and are linked like any other; texts of any length
    are taken whole. Repeated rows each give a row; rows that share an id are linked by their texts alone. A null id
    takes part through its text but is never a component's id (null only if all ids reachable are null). Other
    columns are ignored; an empty table gives no rows. Exact copies meet in an aggregation first, so groups of copies
    cost nothing later."""
    prints = stored(simhash_fingerprints(docs, words, id_col, text_col))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")))
    components = connected_components(near_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    labels = nodes.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labels.join(ids, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The near-duplicate mode: words to a shingle, the least Jaccard similarity, bits between the fingerprints of texts that
#: meet in a table. A pair at 0.8 differs at some 10 bits with a deviation of 3; some differ at more than this.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_RADIUS = 5, 0.8, 19
#: Pairs within so many bits meet in one of 15 tables for sure, others by chance.
TABLE_RADIUS = 3
#: Longs of the shortest parity sketch, which goes along in groups.
SKETCH = 4
#: Texts of a group that the whole group meets in one task.
GROUP_BLOCK = 1024
#: So many of the commonest shingles are known by their rank; it only sets the order of prefixes.
MAX_COMMON = 50_000


def shingle_set(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """A hash of the lower-cased words of a text; its distinct shingles' hashes, sorted (of the whole text if it
    has fewer words)."""
    _, _, found = word_hashes((text or "").encode().translate(_LOWER))
    if not len(found):
        return 0, np.zeros(0, dtype=np.uint64)
    places = np.arange(1, len(found) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = int(np.bitwise_xor.reduce(mix(found + places)).view(np.int64))
    return whole, np.unique(gram_hashes(found, min(words, len(found))))


def _common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, sorted, and their places from the rarest on. Counts are by batch, and a batch sends
    only what several of its texts have; at most MAX_COMMON rows come to the driver."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            sets = [shingle_set(t, words)[1] for t in batch.column(0).to_pylist()]
            values, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), return_counts=True)
            often = counts >= 4
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["g", "n"])

    sums = texts.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = [g for g, _ in commonest(sums, "g", "n", MAX_COMMON)]
    values = np.array(found, dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - np.arange(len(values)))[order]


def parity_sketch(grams: np.ndarray) -> list[int]:
    """For each place, whether an odd number of the shingles falls on it: about as many places as shingles, a power of
    two, in longs. The sketches of two sets differ at no more places than there are shingles that only one of them has;
    half of a sketch laid over the other half is the sketch of half as many places."""
    longs = max(SKETCH, 1 << max(0, len(grams) - 1).bit_length() >> 6)
    places = np.bincount((grams >> np.uint64(32)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").view("<i8").tolist()


def shortest_sketch(sketch: list[int]) -> list[int]:
    """The sketch laid over itself down to SKETCH longs."""
    return np.bitwise_xor.reduce(np.array(sketch, dtype=np.int64).reshape(-1, SKETCH)).tolist()


_SKETCH = tuple(f"s{i}" for i in range(SKETCH))


def near_duplicate_rows(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key (the ``row_key`` of the row), component (a name of its group). Texts link if the Jaccard
    similarity of their ``words``-word shingles is ``similarity`` or more, however far their fingerprints are.

    Texts of the same lower-cased words meet in an aggregation first. Fingerprints are looked up in covering tables: each
    text meets the two ends of its buckets, within ``radius`` bits. At this similarity 64 bits cannot tell all pairs from
    chance, so an exact way follows for those that no table brought together: two sets at a Jaccard similarity t share
    one of the first n - ceil(t n) + 1 shingles of each in any common order; the order puts common shingles last, so
    these prefixes share little else. Texts meet the two ends of their prefix shingles' groups, and what shares a shingle
    but no component after that meets pair by pair, a block of a group per task. There parity sketches leave out, without
    a loss, nearly all pairs that are less alike; what they leave is compared exactly. So a group of m near copies
    makes O(m) rows and those that do link. A null text counts as empty; texts of any length are taken whole; repeated
    rows each give a row; other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("key", row_key())
    common = spark.sparkContext.broadcast(_common_shingles(texts, words))

    def judge():
        values, places = common.value

        def one(found):
            rows = []
            for text in found:
                whole, grams = shingle_set(text, words)
                n = len(grams)
                place = np.zeros(n, dtype=np.int64)
                if n and len(values):
                    at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
                    place = np.where(values[at] == grams, places[at], 0)
                first = np.lexsort((grams, place))[: n - math.ceil(similarity * n - 1e-9) + 1]  # in the common order
                sketch = parity_sketch(grams)
                rows.append((whole, fingerprint(grams), n, grams[first].view(np.int64), sketch, *shortest_sketch(sketch)))
            return rows

        return one

    with scratch(spark):
        sketch = ", ".join(f"{c} long" for c in _SKETCH)
        prints = stored(map_texts(texts, f"node long, fp long, n int, prefix array<bigint>, sketch array<bigint>, {sketch}", judge, keep=("doc_id", "key")))
        # Only texts whose words may occur again are shuffled to leave one of each.
        single, several = apart(prints, "node", prints.groupBy("node").count().where("count > 1").select("node"))
        columns = ("key", "fp", "n", *_SKETCH, "sketch", "prefix")
        one = several.groupBy("node").agg(F.min_by(F.struct(*columns), F.coalesce("doc_id", F.lit(0))).alias("x")).select("node", "x.*")
        nodes = single.select("node", *columns).unionByName(one)
        known = stored(nodes.drop("prefix"))
        sizes = known.select("node", "fp", "n", *_SKETCH)
        group = Window.partitionBy("g")
        rows = nodes.select("node", F.posexplode("prefix").alias("p", "g"))
        held = stored(rows.select("g", "p", "node", *_ends(group), F.ceil(F.count("*").over(group) / GROUP_BLOCK).cast("int").alias("blocks")).where("b <> c"))
        tables = _near(_table_ends(sizes), sizes, similarity, radius)
        groups = _near(held.select("node", F.explode(F.array("b", "c")).alias("b")), sizes, similarity)
        links = _alike(texts, _likely(tables.unionByName(groups), known, similarity), known, words, similarity)
        components = connected_components(links)
        # What is left is compared pair by pair, where a shared shingle stands so early in both that all may agree.
        split = stored(_split(held.drop("b", "c"), components).join(sizes.drop("fp"), "node"))
        left = split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = split.select("g", F.pmod("node", "blocks").cast("int").alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("p", "node", "component", "n", *_SKETCH)])
        early = F.least(F.col("n") - F.col("p"), F.col("b_n") - F.col("b_p")) >= similarity / (1 + similarity) * (F.col("n") + F.col("b_n")) - 1e-9
        rest = left.join(right, ["g", "block"]).where((F.col("component") < F.col("b_component")) & early & _fits(similarity))
        rest = _likely(rest.select("node", F.col("b_node").alias("b")), known, similarity)
        links = links.unionByName(_alike(texts, rest, known, words, similarity))
        components = connected_components(links)
        labels = prints.select("doc_id", "key", "node").join(components, "node", "left")
        found = stored(labels.select("doc_id", "key", F.coalesce("component", "node").alias("component")))
        return kept(found)


def _ends(group: Window) -> tuple[Column, Column]:
    """The least and the largest name of a group. Names are hashes, so these are two of its texts at random."""
    return F.min("node").over(group).alias("b"), F.max("node").over(group).alias("c")


def _table_ends(sizes: DataFrame) -> DataFrame:
    """(node, b): each text with the two ends of its buckets in the covering tables of fingerprints."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(covering_masks(TABLE_RADIUS))])
    rows = sizes.select("node", F.explode(tables).alias("x")).select("node", "x.*")
    return rows.select("node", *_ends(Window.partitionBy("t", "bits"))).where("b <> c").select("node", F.explode(F.array("b", "c")).alias("b"))


def _fits(similarity: float) -> Column:
    """Whether two texts may be alike by their sizes and shortest sketches."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH), F.lit(0))
    return (F.least("n", "b_n") >= similarity * F.greatest("n", "b_n") - 1e-9) & _few(differ, similarity)


def _few(differ: Column, similarity: float) -> Column:
    """Sets at a similarity t have at most (1 - t) / (1 + t) of their sizes' sum apart."""
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("b_n")) + 1e-9


def _likely(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The different pairs (node, b) that may be alike by their whole sketches, the longer one laid over itself. Their
    sizes fit, so it is twice as long at most."""
    own = pairs.select(F.greatest("node", "b").alias("node"), F.least("node", "b").alias("b")).distinct()
    x, y = known.select("node", "n", F.col("sketch").alias("x")), known.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("y"))
    xor = lambda p, q: p.bitwiseXOR(q)
    longs = F.least(F.size("x"), F.size("y"))
    over = lambda c: F.when(F.size(c) > longs, F.zip_with(F.slice(c, F.lit(1), longs), F.slice(c, longs + 1, longs), xor)).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(over("x"), over("y"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return own.join(x, "node").join(y, "b").where(_few(differ, similarity)).select("node", "b")


def _near(pairs: DataFrame, sizes: DataFrame, similarity: float, radius: int | None = None) -> DataFrame:
    """The different pairs (node, b) that may be alike, within ``radius`` bits if given."""
    own = pairs.where("node <> b").select(F.least("node", "b").alias("node"), F.greatest("node", "b").alias("b")).distinct()
    other = sizes.select(*[F.col(c).alias("b" if c == "node" else f"b_{c}") for c in sizes.columns])
    close = F.lit(True) if radius is None else F.bit_count(F.col("fp").bitwiseXOR(F.col("b_fp"))) <= radius
    return own.join(sizes, "node").join(other, "b").where(close & _fits(similarity)).select("node", "b")


def _split(held: DataFrame, components: DataFrame) -> DataFrame:
    """Rows (g, p, node, blocks) with their component, of the groups that have more than one."""
    known = held.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = known.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    return known.join(several, "g", "left_semi").select("g", "p", "node", "blocks", "component")


def near_duplicate_components(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, component_id (the smallest doc_id reachable over links, itself included; null if no row of the
    component has an id). Links, nulls and repeats are those of ``near_duplicate_rows``."""
    labels = stored(near_duplicate_rows(docs, words, similarity, radius, id_col, text_col))
    ids = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labels.join(ids, "component").select("doc_id", "component_id")


def _alike(texts: DataFrame, pairs: DataFrame, known: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the different pairs (node, b) whose sets of shingles have the similarity, as edges (a, b). The texts go to
    the pairs packed, a third of the size of their sets of hashes; sets are made anew where both are."""
    import pyarrow as pa

    pairs = stored(pairs.select(F.col("node").alias("a"), "b"))
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node", "key"), "node"))

    def pack():
        return lambda found: [(zlib.compress((text or "").encode().translate(_LOWER), 6),) for text in found]

    some = map_texts(apart(texts, "key", wanted.select("key"))[1], "packed binary", pack, keep=("key",))
    sets = stored(some.join(wanted, "key").groupBy("key", "node").agg(F.any_value("packed").alias("packed")).select("node", "packed"))

    def judge(batches):
        made = lambda packed: shingle_set(zlib.decompress(packed).decode(), words)[1]
        last = one = None
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                if b[i] != last:  # pairs come in the order of b
                    last, one = b[i], made(y[i])
                other = made(x[i])
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(other) - both) - 1e-9)
            found = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"))
