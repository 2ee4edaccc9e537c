"""Substring dedup on bytes: two-stage suffix sorting inside groups of candidate segments.

A segment is a stretch of windows that share an anchor; its anchor's hash names its group (that of a longer string
around it where the anchor is in very many blocks), so equal windows meet. A group's segments make one text. Its suffixes that are smaller than their successors are sorted
directly; the others are induced by scans over the buckets of first bytes. Adjacent common prefixes of at
least the window's length then join equal windows, and all but those of the smallest id are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import span_hashes
from .repeats import HOT_BLOCKS, Kind, anchor_replies, best_of_copies, candidates, covered, dealt, merged, open_block, pack, pack_blocks, reduce_to_runs, text_bytes, text_of, unpack

WINDOW = 50
GROUP_BYTES = 6 << 20


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes at least, by two-stage sorting:
    all, or those ``wanted`` and the few more that their induction starts from."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # Type B: smaller than the successor. Runs of one byte take the type of what follows; the end is smallest.
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    decided = np.flatnonzero(step)
    small = np.repeat(step[decided] > 0, np.diff(decided, prepend=-1))
    # A wanted suffix of type A needs all up to the next one of type B.
    need = np.ones(n, dtype=bool)
    if wanted is not None:
        next_b = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
        at = np.flatnonzero(wanted)
        ends = np.bincount(np.minimum(next_b[at] + 1, n), minlength=n + 1)
        need = np.cumsum(wanted - ends[:-1]) > 0
    # Stage one: sort the type B suffixes directly.
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    b = np.flatnonzero(small & need)
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[b]
    b = b[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    del rows
    # Stage two: scan the buckets of first bytes in order; what precedes a suffix and is of type A comes next
    # in the bucket of its own first byte, where type A stands before type B.
    b_from = np.searchsorted(text[b], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[n - 1]:
        queues[text[n - 1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    large = need & ~small
    out = []

    def induce(suffixes: np.ndarray, c: int) -> np.ndarray:
        before = suffixes[suffixes > 0] - 1
        before = before[large[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.diff(first.astype(np.int16), prepend=-1))
        own = before[:0]
        for a, z in zip(cut, np.append(cut[1:], len(before))):
            if first[a] == c:
                own = before[a:z]
            else:
                queues[first[a]].append(before[a:z])
        return own

    for c in range(256):
        waiting = queues[c]
        ready = np.concatenate(waiting) if waiting else b[:0]
        while len(ready):  # runs of c: each round takes one more byte
            out.append(ready)
            ready = induce(ready, c)
        queues[c] = []
        mine = b[b_from[c] : b_from[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    return np.concatenate(out) if out else b


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix with the one before it, up to ``depth``; all have ``depth`` bytes."""
    out = np.zeros(len(suffixes), dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(text, depth)
    for lo in range(1, len(suffixes), 1 << 18):
        here = suffixes[lo : lo + (1 << 18)]
        differ = windows[here] != windows[suffixes[lo - 1 : lo - 1 + len(here)]]
        out[lo : lo + len(here)] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def repeated_windows(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Positions in ``text``, segments of ``sizes`` end to end, of windows that a segment of a smaller id also has."""
    begin = np.cumsum(sizes) - sizes
    segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inside = np.arange(len(text)) <= (begin + sizes - window)[segment]
    order = suffix_array(text, window, inside)
    order = order[inside[order]]
    owner = ids[segment[order]]
    first = np.flatnonzero(common_prefixes(text, order, window) < window)
    least = np.minimum.reduceat(owner, first) if len(first) else owner
    group = np.zeros(len(order), dtype=np.int64)
    group[first[1:]] = 1
    return order[owner > least[np.cumsum(group)]] if len(order) else order


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = 20, hot_blocks: int = HOT_BLOCKS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes with ``with_text``), once
    each byte is removed that lies in a string of ``window`` bytes which also starts in a document with a
    smaller doc_id. Matches never cross documents and are judged on the input.

    A null text counts as empty. A null id counts as larger than any other. Rows that share an id never
    remove each other's bytes. Other columns are ignored; an empty table gives no rows. Texts of any length
    are taken whole. Copies in a block are settled there, so a group of copies sends a row per block. Anchors in
    more than ``hot_blocks`` blocks are dealt out by more of their text: windows that begin far before the anchor hold
    half of the slack before it, the others half of the slack after it, so that half and the anchor name their group."""
    import pandas as pd
    import pyarrow as pa

    kind = Kind(words=False, length=window, k=gram)
    half = (window - gram) // 2
    blocks = pack_blocks(docs, id_col, text_col)
    size = text_bytes(blocks)
    buckets, groups = (max(8, -(-size // per)) for per in (4 * GROUP_BYTES, GROUP_BYTES))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = open_block(kind, row["ids"], row["sizes"], row["data"])
                found = candidates(kind, block, row["replies"], buckets)
                if not len(found.start):
                    continue
                late = found.hot[found.anchor] & (found.start > found.place[found.anchor] - half)
                new = np.ones(len(found.start), dtype=bool)
                new[1:] = (found.anchor[1:] != found.anchor[:-1]) | (late[1:] != late[:-1])
                head = np.flatnonzero(new)
                start = found.start[head]
                end = found.start[np.append(head[1:], len(new)) - 1] + window
                ids = block.ids[text_of(block, start)]
                name = span_hashes(block.codes, start, end)
                raw = np.frombuffer(block.data, dtype=np.uint8)
                keep, beaten = best_of_copies(name, ids, lambda a, b: equal_bytes(raw, start, end, a, b))
                if beaten.any():
                    yield rows([-1 - row["block_id"] % groups], row["block_id"], [pack(*merged(start[beaten], end[beaten]))])
                anchor = found.anchor[head]
                key = found.value[anchor].copy()
                at = np.flatnonzero(found.hot[anchor])
                place = found.place[anchor[at]] - np.where(late[head[at]], 0, half)
                key[at] = span_hashes(block.codes, place, place + gram + half)
                grp = (key >> np.uint64(20)).astype(np.int64) % groups
                order = np.flatnonzero(keep)
                order = order[np.argsort(grp[order], kind="stable")]
                cut = np.flatnonzero(np.diff(grp[order], prepend=-1))
                payloads = []
                for a, z in zip(cut, np.append(cut[1:], len(order))):
                    s, e = start[order[a:z]], end[order[a:z]]
                    payloads.append(pack(raw[ranges(s, e)], (e - s).astype(np.uint16), ids[order[a:z]], s))
                yield rows(grp[order[cut]], row["block_id"], payloads)

    def rows(grp, block_id, payloads):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(grp, dtype=np.int64)), pa.array(np.full(len(payloads), block_id)), pa.array(payloads, type=pa.binary())], names=["grp", "block_id", "payload"])

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        if group["grp"].iloc[0] < 0:
            return group[["block_id", "payload"]].rename(columns={"payload": "runs"})
        parts = [unpack(p, np.uint8, np.uint16, np.int64, np.int64) for p in group["payload"]]
        text = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts]).astype(np.int64)
        ids, begin = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        hits = repeated_windows(text, sizes, ids, window)
        offset = np.cumsum(sizes) - sizes
        segment = np.searchsorted(offset, hits, side="right") - 1
        place = begin[segment] + hits - offset[segment]
        owner = np.searchsorted(np.cumsum([len(p[1]) for p in parts]), segment, side="right")
        order = np.argsort(owner, kind="stable")
        place, owner = place[order], owner[order]
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, z in zip(cut, np.append(cut[1:], len(owner))):
            out.append((group["block_id"].iloc[owner[a]], pack(*merged(place[a:z], place[a:z] + window))))
        return pd.DataFrame(out, columns=["block_id", "runs"])

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = open_block(kind, row["ids"], row["sizes"], row["data"])
                gone = covered(len(block.data), row["runs"] or [])
                edge = np.diff(gone.astype(np.int8), prepend=0) == 1
                raw = np.frombuffer(block.data, dtype=np.uint8)
                out = []
                for i, s, e in zip(row["ids"], block.text_start.tolist(), block.text_end.tolist()):
                    lost = gone[s:e]
                    n = int(np.count_nonzero(lost))
                    kept = raw[s:e][~lost].tobytes() if n else block.data[s:e]
                    spans = int(np.count_nonzero(edge[s:e])) if n else 0
                    out.append((i, e - s, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    replies = anchor_replies(blocks, kind, buckets, size, hot_blocks)
    placed = dealt(blocks, "block_id", size)
    sent = placed.join(replies, "block_id").mapInArrow(send, "grp long, block_id long, payload binary")
    runs = reduce_to_runs(sent, resolve, size)
    done = placed.join(runs, "block_id", "left").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of [start, end), one interval after the other."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    out = np.ones(sizes.sum(), dtype=np.int64)
    out[0] = starts[0]
    out[np.cumsum(sizes)[:-1]] = starts[1:] - ends[:-1] + 1
    return np.cumsum(out)


def equal_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the segments ``a`` have the bytes of their partners in ``b``."""
    same = end[a] - start[a] == end[b] - start[b]
    for lo in range(0, len(a), 1 << 16):  # a part at a time bounds the memory
        part = np.flatnonzero(same[lo : lo + (1 << 16)]) + lo
        if len(part):
            x, y = a[part], b[part]
            sizes = end[x] - start[x]
            agree = raw[ranges(start[x], end[x])] == raw[ranges(start[y], end[y])]
            same[part] = np.logical_and.reduceat(agree, np.cumsum(sizes) - sizes)
    return same
