"""What both substring operators share: which windows of a corpus can repeat at all, found losslessly.

Texts are packed into blocks of a few MB, written once to the shared folder. A window of ``length`` symbols
(words or bytes) is named by its anchor, the k-gram with the smallest hash in it: equal windows have equal
anchors. Blocks send the hashes of their anchors to buckets; an anchor that only one document has cannot be
in a repeated window, so all windows under it drop out. What is left goes on to the suffix structures. All
that a block sends is one entry per distinct anchor, whatever the copies in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, byte_codes, id_and_text, mix, shared_dir, sliding_min, word_hashes

BLOCK_BYTES = 4 << 20
#: Text to a task of a shuffle.
TASK_BYTES = 16 << 20
#: Anchors in more blocks than this are hot: their windows are dealt out by more of their content.
HOT_BLOCKS = 250
_CHUNK = 1 << 22
_POSITION = np.uint64((1 << 24) - 1)
_NO_ID = (1 << 63) - 1
_K = 0x9E3779B97F4A7C15


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([a.nbytes for a in arrays], dtype=np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 3)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    at = 8 * len(kinds)
    out = []
    for size, kind in zip(np.frombuffer(raw, dtype=np.int64, count=len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def pack_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block_id, ids, sizes, data): texts of at least BLOCK_BYTES together, or what a task has left; joined
    by a newline and compressed. A null text counts as empty."""
    import pyarrow as pa

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def block():
            nonlocal ids, texts, size, made
            row = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([ids], type=pa.list_(pa.int64())), pa.array([np.array([len(t) for t in texts], dtype=np.int64).tobytes()]), pa.array([zstandard.compress(b"\n".join(texts), 3)])],
                names=["block_id", "ids", "sizes", "data"],
            )
            ids, texts, size, made = [], [], 0, made + 1
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    ids.append(i)
                    texts.append((t or "").encode())
                    size += len(texts[-1])
                    if size >= BLOCK_BYTES:
                        yield block()
        if ids:
            yield block()

    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = source.mapInArrow(run, "block_id long, ids array<long>, sizes binary, data binary")
    path = shared_dir(spark)
    blocks.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


@dataclass(frozen=True)
class Kind:
    """Windows of ``length`` symbols, anchors of ``k``; symbols are words or bytes."""

    words: bool
    length: int
    k: int


@dataclass
class Block:
    """A block's texts and the symbols in them."""

    ids: np.ndarray  # doc ids; a null id counts as the largest
    data: bytes
    text_start: np.ndarray  # byte offsets of the texts
    text_end: np.ndarray
    codes: np.ndarray  # 64-bit codes of the symbols
    symbol_start: np.ndarray  # of each text, in symbols
    symbol_end: np.ndarray


def open_block(kind: Kind, ids: list, sizes: bytes, data: bytes) -> Block:
    import zstandard

    plain = zstandard.decompress(data)
    size = np.frombuffer(sizes, dtype=np.int64)
    end = np.cumsum(size + 1) - 1
    start = end - size
    if kind.words:
        at, _, codes = word_hashes(plain)
        first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    else:
        codes, first, last = byte_codes(plain), start, end
    return Block(np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64), plain, start, end, codes, first, last)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, by doubling."""
    out, have = codes, 1
    power = _K
    while have < k:
        step = min(have, k - have)
        if step == have:
            out = out[:-step] * np.uint64(power) + out[step:]
            power = power * power & MASK64
        else:  # the last step symbols of the k-gram, one by one
            for j in range(step):
                out = out[:-1] * np.uint64(_K) + codes[have + j :][: len(out) - 1]
        have += step
    return mix(out)


def anchors(kind: Kind, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside texts, the index of each one's anchor, and the anchors' positions and
    hashes. Work goes in chunks, so a text of any length takes bounded memory beyond its symbols."""
    n, length, k = len(block.codes), kind.length, kind.k
    edge = np.zeros(n + 1, dtype=np.int32)
    long = block.symbol_end - block.symbol_start >= length
    np.add.at(edge, block.symbol_start[long], 1)
    np.add.at(edge, block.symbol_end[long] - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    starts, places, hashes = [], [], []
    for lo in range(0, n - length + 1, _CHUNK):
        hi = min(lo + _CHUNK, n - length + 1)
        valid = np.flatnonzero(inside[lo:hi])
        if not len(valid):
            continue
        grams = gram_hashes(block.codes[lo : hi + length - 1], k)
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(keys, length - k + 1)[valid] & _POSITION).astype(np.int64)
        starts.append(valid + lo)
        places.append(place + lo)
        hashes.append(grams[place])
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    start, place, value = np.concatenate(starts), np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    return start, np.cumsum(new) - 1, place[new], mix(value[new])


def text_of(block: Block, position: np.ndarray) -> np.ndarray:
    """Indexes of the texts that hold the symbols."""
    return np.searchsorted(block.symbol_end, position, side="right")


def sorted_anchors(values: np.ndarray, texts: np.ndarray, buckets: int):
    """Distinct hashes by bucket, then by what is sent of them: order of the anchors, index of each one's
    distinct hash, bucket and 40 bits of each distinct hash, whether more than one text has it."""
    low, bucket = values & np.uint64((1 << 40) - 1), (values >> np.uint64(40)) % np.uint64(buckets)
    name = bucket << np.uint64(40) | low
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    several = texts[order[first]] != texts[order[last]] if len(first) else np.zeros(0, dtype=bool)
    index = np.empty(len(order), dtype=np.int64)
    index[order] = np.cumsum(new) - 1
    return index, (ranked[first] >> np.uint64(40)).astype(np.int64), ranked[first] & np.uint64((1 << 40) - 1), several


def anchor_replies(blocks: DataFrame, kind: Kind, buckets: int, size: int, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(block_id, replies): for each block and bucket, two bits for each distinct anchor in order: whether more
    than one text has it, and whether it is hot."""
    import pandas as pd
    import pyarrow as pa

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = open_block(kind, row["ids"], row["sizes"], row["data"])
                _, _, place, value = anchors(kind, block)
                if not len(place):
                    continue
                _, bucket, low, several = sorted_anchors(value, text_of(block, place), buckets)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                end = np.append(cut[1:], len(bucket))
                raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array(np.full(len(cut), row["block_id"])), pa.array([raw[a:b].tobytes() for a, b in zip(cut, end)]), pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cut, end)])],
                    names=["bucket", "block_id", "low", "several"],
                )

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) // 5 for x in group["low"]])
        low = np.zeros((sizes.sum(), 8), dtype=np.uint8)
        low[:, :5] = np.frombuffer(b"".join(group["low"]), dtype=np.uint8).reshape(-1, 5)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(group["several"], sizes)])
        _, index, counts = np.unique(low.view("<u8").ravel(), return_inverse=True, return_counts=True)
        counts = counts[index]
        repeated, hot = (counts > 1) | (several > 0), counts > hot_blocks
        at = np.concatenate([[0], np.cumsum(sizes)])
        bits = [pack(np.packbits(repeated[a:b]), np.packbits(hot[a:b])) for a, b in zip(at, at[1:])]
        return pd.DataFrame({"block_id": group["block_id"], "bucket": group["bucket"], "bits": bits})

    sent = blocks.mapInArrow(send, "bucket long, block_id long, low binary, several binary")
    answers = dealt(sent, "bucket", size).groupBy("bucket").applyInPandas(answer, "block_id long, bucket long, bits binary")
    return dealt(answers, "block_id", size).groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("replies"))


@dataclass
class Candidates:
    """Windows whose anchor more than one text has."""

    start: np.ndarray
    anchor: np.ndarray  # index into the anchors
    place: np.ndarray  # of the anchors
    value: np.ndarray  # hashes of the anchors
    hot: np.ndarray  # by anchor


def candidates(kind: Kind, block: Block, replies: list | None, buckets: int) -> Candidates:
    start, anchor, place, value = anchors(kind, block)
    if not len(place) or not replies:
        none = np.zeros(0, dtype=np.int64)
        return Candidates(none, none, none, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool))
    index, bucket, _, _ = sorted_anchors(value, text_of(block, place), buckets)
    repeated, hot = np.zeros(len(bucket), dtype=bool), np.zeros(len(bucket), dtype=bool)
    for reply in replies:
        a, b = np.searchsorted(bucket, [reply["bucket"], reply["bucket"] + 1])
        bits = unpack(reply["bits"], np.uint8, np.uint8)
        repeated[a:b], hot[a:b] = (np.unpackbits(x, count=b - a) for x in bits)
    keep = repeated[index][anchor]
    return Candidates(start[keep], anchor[keep], place, value, hot[index])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, sorted."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def covered(n: int, runs: list[bytes]) -> np.ndarray:
    """Which of n symbols the runs of a block cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for blob in runs:
        starts, ends = unpack(blob, np.int64, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def best_of_copies(name: np.ndarray, ids: np.ndarray, equal) -> tuple[np.ndarray, np.ndarray]:
    """Of items with equal names in a block: which to send (all of the smallest id), and which the block
    itself shows to have a copy under a smaller id; ``equal(a, b)`` says which pairs of items are equal in content, and
    only those count."""
    order = np.lexsort((ids, name))
    ranked = name[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    head = order[new][np.cumsum(new) - 1]
    later = ids[order] > ids[head]
    beaten = np.zeros(len(order), dtype=bool)
    beaten[order[later]] = equal(order[later], head[later])
    return ~beaten, beaten


def text_bytes(blocks: DataFrame) -> int:
    """About how many bytes of text the blocks hold."""
    return 3 * (blocks.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0)  # data is about a third of the text


def dealt(df: DataFrame, by: str, size: int) -> DataFrame:
    """Rows dealt out by a column to partitions whose number grows with the text, so that a task's share does not."""
    return df.repartition(max(8, -(-size // TASK_BYTES)), by)


def reduce_to_runs(sent: DataFrame, resolve, size: int) -> DataFrame:
    """``sent`` (grp, block_id, payload) → (block_id, runs): what ``resolve`` finds in each group, gathered by
    block. Rows with a negative ``grp`` hold runs already."""
    found = dealt(sent, "grp", size).groupBy("grp").applyInPandas(resolve, "block_id long, runs binary")
    return dealt(found, "block_id", size).groupBy("block_id").agg(F.collect_list("runs").alias("runs"))
