"""Substring dedup on words: prefix-partitioned suffix trees over candidate suffixes.

The suffix at each word is known by a path: for each depth d some bits that hash its first d words (a byte at the
first two depths, then four bits), and at the last depth 64 bits of the whole window. Suffixes are split by variable-length prefixes: the first word's byte,
two words' bytes where that prefix is too frequent, the whole path where both are; neighbouring small prefixes
share a group. A group's suffixes in path order are the leaves of its subtree, and the common depths of
neighbours its internal nodes; those as deep as the window are the repeats. Deeper branching cannot change
which words a repeat covers, so paths end there. Windows count as equal if all steps and the name agree, some 120 bits of
hashes of different prefixes; copies in a block are compared word by word.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .repeats import Kind, anchor_replies, best_of_copies, candidates, covered, dealt, merged, open_block, pack, pack_blocks, reduce_to_runs, text_bytes, text_of, unpack

WINDOW = 13
GROUP_BYTES = 24 << 20
#: Suffixes that a group's prefix may have before it is made longer.
GROUP_SUFFIXES = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def paths(codes: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix its steps at depths 1 to depth - 1, and the 64-bit name of its first ``depth`` words."""
    path = np.empty((len(start), depth - 1), dtype=np.uint8)
    value = codes[start].copy()
    for d in range(depth - 1):
        path[:, d] = mix(value) >> np.uint64(56 if d < 2 else 60)
        value = value * _K + codes[start + d + 1]
    return path, mix(value)


def narrow(path: np.ndarray) -> np.ndarray:
    """Paths with two of the small steps to a byte."""
    steps = path[:, 2:]
    if steps.shape[1] % 2:
        steps = np.hstack([steps, np.zeros((len(path), 1), dtype=np.uint8)])
    return np.hstack([path[:, :2], steps[:, ::2] << 4 | steps[:, 1::2]])


def widen(narrowed: np.ndarray, depth: int) -> np.ndarray:
    steps = np.stack([narrowed[:, 2:] >> 4, narrowed[:, 2:] & 15], axis=2).reshape(len(narrowed), -1)
    return np.hstack([narrowed[:, :2], steps])[:, : depth - 1]


def prefix_counts(blocks: DataFrame, kind: Kind) -> np.ndarray:
    """How many suffixes have each pair of first bytes, over all texts: 2**16 sums, whatever the input."""
    import pyarrow as pa

    def count(batches):
        sums = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                codes = open_block(kind, row["ids"], row["sizes"], row["data"]).codes
                if len(codes) > 2:
                    path, _ = paths(codes, np.arange(len(codes) - 2), 3)
                    sums += np.bincount(path[:, 0].astype(np.int64) << 8 | path[:, 1], minlength=1 << 16)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["prefix", "n"])

    found = blocks.mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(1 << 16, dtype=np.int64)
    sums[found["prefix"].to_numpy()] = found["n"].to_numpy()
    return sums


def split_prefixes(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each pair of first bytes: its group, and over how many groups from there on the whole path deals
    it; the number of groups. A prefix grows until it has at most ``most`` suffixes, and neighbours share a
    group up to that size."""
    base, parts = np.zeros(1 << 16, dtype=np.int64), np.ones(1 << 16, dtype=np.int64)
    group, held = 0, 0
    for a in range(256):
        row = counts[a << 8 : (a + 1) << 8]
        units = [(a << 8, 256, int(row.sum()))] if row.sum() <= most else [(a << 8 | b, 1, int(n)) for b, n in enumerate(row)]
        for first, width, n in units:
            if n > most:
                group, held = group + (held > 0), 0
                base[first], parts[first] = group, -(-n // most)
                group += parts[first]
                continue
            if held + n > most:
                group, held = group + 1, 0
            base[first : first + width] = group
            held += n
    return base, parts, int(group + 1)


def deep_nodes(path: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of the subtree, and the depth (in words) of the node that joins each one with the
    leaf before it; ``path.shape[1] + 1`` where the whole window agrees."""
    depth = path.shape[1]
    wide = np.zeros((len(path), -(-depth // 8) * 8), dtype=np.uint8)
    wide[:, :depth] = path
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((name, *(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1))))
    joined = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        ranked = path[order]
        differ = ranked[1:] != ranked[:-1]
        same = name[order[1:]] == name[order[:-1]]
        joined[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), np.where(same, depth + 1, depth))
    return order, joined


def repeated_suffixes(path: np.ndarray, name: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indexes of the suffixes below a deep node that also has a leaf of a smaller id."""
    if not len(path):
        return np.zeros(0, dtype=np.int64)
    order, joined = deep_nodes(path, name)
    first = np.flatnonzero(joined <= path.shape[1])
    least = np.minimum.reduceat(ids[order], first)
    node = np.zeros(len(order), dtype=np.int64)
    node[first[1:]] = 1
    return order[ids[order] > least[np.cumsum(node)]]


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", group_suffixes: int = GROUP_SUFFIXES, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and the kept text with ``with_text``), once each word
    is removed that a window of ``window`` words covers which also starts in a document with a smaller doc_id.
    Windows never cross documents and are judged on the input. Kept words are joined by one space.

    A null text has no words. A null id counts as larger than any other. Rows that share an id never remove
    each other's words. Other columns are ignored; an empty table gives no rows. Texts of any length are
    taken whole. Copies in a block are settled there, so a group of copies sends a row per block."""
    import pandas as pd
    import pyarrow as pa

    kind = Kind(words=True, length=window, k=gram)
    blocks = pack_blocks(docs, id_col, text_col)
    size = text_bytes(blocks)
    buckets = max(8, -(-size // (4 * GROUP_BYTES)))
    base, parts, groups = split_prefixes(prefix_counts(blocks, kind), group_suffixes)
    tables = docs.sparkSession.sparkContext.broadcast((base, parts))  # 2**16 entries each, whatever the input

    def send(batches):
        base, parts = tables.value
        for batch in batches:
            for row in batch.to_pylist():
                block = open_block(kind, row["ids"], row["sizes"], row["data"])
                found = candidates(kind, block, row["replies"], buckets)
                if not len(found.start):
                    continue
                start = found.start
                path, name = paths(block.codes, start, window)
                ids = block.ids[text_of(block, start)]
                codes = block.codes
                keep, beaten = best_of_copies(name, ids, lambda a, b: np.logical_and.reduce([codes[start[a] + d] == codes[start[b] + d] for d in range(window)]))
                if beaten.any():
                    yield rows([-1 - row["block_id"] % groups], row["block_id"], [pack(*merged(start[beaten], start[beaten] + window))])
                prefix = path[:, 0].astype(np.int64) << 8 | path[:, 1]
                grp = base[prefix] + ((name >> np.uint64(16)).astype(np.int64) & 0xFFFFFFFF) % parts[prefix]
                order = np.flatnonzero(keep)
                order = order[np.argsort(grp[order], kind="stable")]
                cut = np.flatnonzero(np.diff(grp[order], prepend=-1))
                payloads = []
                for a, z in zip(cut, np.append(cut[1:], len(order))):
                    at = order[a:z]
                    payloads.append(pack(narrow(path[at]), name[at], ids[at], np.diff(start[at], prepend=0)))
                yield rows(grp[order[cut]], row["block_id"], payloads)

    def rows(grp, block_id, payloads):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(grp, dtype=np.int64)), pa.array(np.full(len(payloads), block_id)), pa.array(payloads, type=pa.binary())], names=["grp", "block_id", "payload"])

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        if group["grp"].iloc[0] < 0:
            return group[["block_id", "payload"]].rename(columns={"payload": "runs"})
        got = [unpack(p, np.uint8, np.uint64, np.int64, np.int64) for p in group["payload"]]
        name, ids = (np.concatenate([p[i] for p in got]) for i in (1, 2))
        start = np.concatenate([np.cumsum(p[3]) for p in got])
        path = widen(np.concatenate([p[0] for p in got]).reshape(len(name), -1), window)
        hits = repeated_suffixes(path, name, ids)
        place = start[hits].astype(np.int64)
        owner = np.searchsorted(np.cumsum([len(p[1]) for p in got]), hits, side="right")
        order = np.argsort(owner, kind="stable")
        cut = np.flatnonzero(np.diff(owner[order], prepend=-1))
        out = []
        for a, z in zip(cut, np.append(cut[1:], len(order))):
            at = place[order[a:z]]
            out.append((group["block_id"].iloc[owner[order[a]]], pack(*merged(at, at + window))))
        return pd.DataFrame(out, columns=["block_id", "runs"])

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = open_block(kind, row["ids"], row["sizes"], row["data"])
                gone = covered(len(block.codes), row["runs"] or [])
                out = []
                for i, s, e, first, last in zip(row["ids"], block.text_start.tolist(), block.text_end.tolist(), block.symbol_start.tolist(), block.symbol_end.tolist()):
                    words = block.data[s:e].split()
                    lost = gone[first:last]
                    n = int(np.count_nonzero(lost))
                    kept = b" ".join(compress(words, (~lost).tolist()) if n else words)
                    out.append((i, len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    replies = anchor_replies(blocks, kind, buckets, size)
    placed = dealt(blocks, "block_id", size)
    sent = placed.join(replies, "block_id").mapInArrow(send, "grp long, block_id long, payload binary")
    runs = reduce_to_runs(sent, resolve, size)
    done = placed.join(runs, "block_id", "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if with_text else done.drop("kept")
