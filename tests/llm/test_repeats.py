import hashlib
from collections import Counter

import numpy as np
import pytest

from barweave.llm import suffix_array as A
from barweave.llm import suffix_tree as T

from .conftest import pairs

LAST = 1 << 62


def part(s, at, length):
    return s[at : at + length] if isinstance(s, bytes) else tuple(s[at : at + length])


def brute(rows, length, split):
    first = {}
    for i, t in rows:
        s = split(t or "")
        for at in range(len(s) - length + 1):
            key = part(s, at, length)
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        s = split(t or "")
        gone = [False] * len(s)
        for at in range(len(s) - length + 1):
            if first[part(s, at, length)] < (LAST if i is None else i):
                gone[at : at + length] = [True] * length
        out.append((i, s, gone))
    return out


def words(rows, length=13):
    for i, s, gone in brute(rows, length, lambda t: t.encode().split()):
        yield i, len(s), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(s, gone) if not g)).hexdigest()


def strings(rows, length=50):
    for i, s, gone in brute(rows, length, str.encode):
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        yield i, len(s), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(s, gone) if not g)).hexdigest()


@pytest.mark.parametrize("group", [2_000_000, 2_000])
def test_words_against_brute_force(edge_docs, docs, group):
    both = edge_docs.select("doc_id", "text", "kept", "n_words").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'x' as kept", "1 as n_words"))
    got = T.remove_repeated_words(both, group_suffixes=group)
    assert Counter(map(tuple, got.collect())) == Counter(words(pairs(both)))


def test_bytes_against_brute_force(edge_docs, docs):
    both = edge_docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text"))
    got = A.remove_repeated_bytes(both)
    assert Counter(map(tuple, got.collect())) == Counter(strings(pairs(both)))


def thue_morse(size, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def test_long_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words of the two orders collide under every polynomial modulo 2**64."""
    from barweave.llm.common import word_hashes

    a, b = thue_morse(4096, "ab"), thue_morse(4096, "ba")
    assert len(set(word_hashes(f"{a} {b}".encode())[2].tolist())) == 2
    rest = " ".join(["w"] * 12)
    rows = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in T.remove_repeated_words(rows).collect()} == {1: 0, 2: 0, 3: 13}


def test_copies_in_a_block_count_only_if_equal():
    from barweave.llm.repeats import best_of_copies

    raw = np.frombuffer(b"abcabcabd", dtype=np.uint8)
    start, end = np.array([0, 3, 6]), np.array([3, 6, 9])
    keep, beaten = best_of_copies(np.array([7, 7, 7], dtype=np.uint64), np.array([1, 2, 3]), lambda a, b: A.equal_bytes(raw, start, end, a, b))
    assert keep.tolist() == [True, False, True] and beaten.tolist() == [False, True, False]


def test_kept_text_comes_back(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m y")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in T.remove_repeated_words(rows, with_text=True).collect()}
    assert got == {1: "a b c d e f g h i j k l m n", 2: "x y"}


def test_empty_tables(nothing):
    assert T.remove_repeated_words(nothing).count() == 0 and A.remove_repeated_bytes(nothing).count() == 0


def test_hot_anchors_are_dealt_by_more_of_their_text(edge_docs, docs):
    both = edge_docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text"))
    assert Counter(map(tuple, A.remove_repeated_bytes(both, hot_blocks=0).collect())) == Counter(strings(pairs(both)))


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 120)).astype(np.uint8)
        want = sorted(range(len(text)), key=lambda i: text[i:].tobytes())
        assert A.suffix_array(text, 120).tolist() == want
        some = rng.random(len(text)) < 0.3
        got = A.suffix_array(text, 120, some)
        assert [i for i in got.tolist() if some[i]] == [i for i in want if some[i]]


def test_prefixes_cover_all_and_split_the_frequent():
    counts = np.ones(1 << 16, dtype=np.int64)
    counts[5 << 8 | 7] = 10_000
    base, parts, groups = T.split_prefixes(counts, 1_000)
    assert parts[5 << 8 | 7] == 10 and base.max() < groups
    sizes = np.zeros(groups)
    np.add.at(sizes, base[parts == 1], counts[parts == 1])
    assert sizes.max() <= 1_000
