import hashlib
import re

import pytest

import corpus_pipeline
from barweave.llm import pii, stages
from barweave.llm.quality import quality_verdicts
from barweave.llm.sentencepiece_codec import default_model_path

from .test_pages_and_leaks import brute_leaks
from .test_text_operators import brute_masked

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), SF).columns == names


def base_kept(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = {}
    for j in range(len(words) - 2):
        grams.setdefault(tuple(words[j : j + 3]), []).append(j)
    covered = {j + k for found in grams.values() if len(found) > 1 for j in found for k in range(3)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def test_run_against_brute_force(spark):
    """Each stage by plain Python on what the one before kept; the quality score and the span model are those of the
    operators, which tests of their own hold against brute force."""
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality_verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    assert all(base_kept(t) for _, t in rows)
    component, _ = brute_near_components(rows)
    rows = [x for x in rows if component[x[0]] == x[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks(rows, items)}
    rows = [x for x in rows if x[0] not in leaks]
    spans = {r["doc_id"]: [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    want = {}
    for i, text in rows:
        ids = library.encode(brute_masked(text, spans[i]))
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids, library.decode(ids))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["ids"], r["decoded"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 10


#: Columns named like those that the operators make, in documents with ids that repeat or lack.
CLASHES = ("kept", "score", "spans", "key", "n", "component", "node", "_0", "_clean", "shelf", "content", "item_id", "similarity")


def clashing(spark, with_n_chars=True):
    long = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(4)]
    texts = [(1, long[0]), (1, long[1]), (2, long[0]), (2, long[0]), (None, long[2]), (None, long[2]), (None, long[0]), (3, None), (4, ""), (5, " "), (6, long[3] + " mail a@b.co " + " ".join(f"w{j % 80}x{j}" for j in range(3000))), (7, "w0x0 w0x1")]
    rows = [(i, t, *[f"{c}{no}" if no != 3 else f"{c}2" for c in CLASHES], 0) for no, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES) + ", n_chars int")
    return docs if with_n_chars else docs.drop("n_chars")


@pytest.mark.parametrize("n_chars", [True, False])
def test_stages_bear_nulls_repeats_and_clashing_columns(spark, n_chars):
    docs = clashing(spark, n_chars)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(f"w3x{j}" for j in range(30))), (2, None)], "item_id long, text string")
    seen = lambda df: sorted([(r["doc_id"], (r["text"] or "")[:4], r["kept"]) for r in df.collect()], key=repr)
    whole = seen(docs)
    good = stages.keep_good(docs, labels)
    assert good.columns == docs.columns and seen(good) == [x for x in whole if x[1] and x[1].strip() and x[0] != 7]
    one = stages.keep_one_of_each(docs)
    kept = seen(one)
    assert one.columns == docs.columns
    assert [x[0] for x in kept] == [1, 1, 3, 6, 7, None] and {x[2] for x in kept} <= {"kept0", "kept1", "kept4", "kept5", "kept7", "kept10", "kept11"}
    clean = stages.keep_uncontaminated(docs, items)
    assert clean.columns == docs.columns and seen(clean) == [x for x in whole if x[0] != 6]
    hidden = stages.mask(docs)
    assert hidden.dtypes == docs.dtypes and seen(hidden) == whole
    text = {r["doc_id"]: r for r in hidden.collect()}[6]
    assert " mail <EMAIL> " in text["text"] and (not n_chars or text["n_chars"] == len(text["text"]))
    coded = stages.encode(docs)
    assert coded.count() == len(whole) and {"ids", "decoded", "n_tokens"} <= set(coded.columns)
    nothing = docs.limit(0)
    for df in (stages.keep_good(nothing, labels), stages.keep_one_of_each(nothing), stages.keep_uncontaminated(nothing, items), stages.mask(nothing), stages.encode(nothing)):
        assert df.count() == 0


def test_operators_return_the_contracts_columns(spark):
    from barweave.llm.queries import queries

    want = {
        "op1": "doc_id n_words n_removed kept_sha256", "op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op3": "doc_id n_assign n_access n_hex base_sha256 spans", "op4": "page_id url text n_chars",
        "op5": "page_id host path rule verdict", "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op8": "doc_id fingerprint component_id", "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id item_id similarity",
        "op11": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", "op12": "word form root n n_near form_n", "op13": "doc_id held_out score predicted",
    }
    found = {name.split("_")[0]: set(f(spark, SF).columns) for name, f in queries().items()}
    assert set(found) == set(want)
    for name, columns in want.items():
        assert set(columns.split()) <= found[name]


def test_near_dedup_stage_links_what_brute_force_links(spark):
    """Copies of a text at a 5-word Jaccard similarity of 0.7 to 1, a chain of them, exact copies and others."""
    import random

    from barweave.llm.simhash import near_duplicate_components, shingle_set

    random.seed(3)
    made = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = made(random.choice((60, 150, 400)))
        rows.append(base)
        for changes in range(1, 6):  # each changed word takes at most five shingles
            copy = list(base)
            for at in random.sample(range(len(base)), max(1, changes * len(base) // 200)):
                copy[at] = "changed"
            rows.append(copy)
    link = made(200)
    for i in range(8):  # neighbours are near, the ends are not
        rows.append(list(link))
        link[20 * i : 20 * i + 10] = made(10)
    rows += [made(100) for _ in range(10)] + [list(rows[0])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    sets = [set(shingle_set(" ".join(w), 5)[1].tolist()) for w in rows]
    component = list(range(len(rows)))
    near = 0
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                near += sets[a] != sets[b]
                old, new = max(component[a], component[b]), min(component[a], component[b])
                component = [new if c == old else c for c in component]
    assert near > 40
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_components(docs).collect()}
    assert got == dict(enumerate(component))
    assert {r["doc_id"] for r in stages.keep_one_of_each(docs).collect()} == set(component)


def test_near_dedup_edges(spark, edge_docs, nothing):
    from barweave.llm.simhash import near_duplicate_components

    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_components(edge_docs).collect()}
    assert got[0] == got[1] == got[2] == got[3] == 0 and got[100] == 8 and got[101] == 101 and got[None] is None
    assert near_duplicate_components(nothing).count() == 0


def brute_near_components(rows, least=0.8):
    """Components over pairs with a 5-word Jaccard similarity, by an inverted index of all shingles; ids distinct."""
    sets = {}
    for i, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else {()}
    holders, overlap = {}, {}
    for i in sorted(sets):
        for g in sets[i]:
            for j in holders.setdefault(g, []):
                overlap[j, i] = overlap.get((j, i), 0) + 1
            holders[g].append(i)
    component = {i: i for i in sets}
    pairs = [(a, b) for (a, b), n in overlap.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs:
        old, new = max(component[a], component[b]), min(component[a], component[b])
        component = {i: new if c == old else c for i, c in component.items()} if old != new else component
    return component, sum(sets[a] != sets[b] for a, b in pairs)


def test_near_dedup_on_the_table(spark):
    from barweave.llm.simhash import near_duplicate_components

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    component, near = brute_near_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert near > 5
    assert {r["doc_id"]: r["component_id"] for r in near_duplicate_components(docs).collect()} == component


def test_near_dedup_links_texts_with_far_fingerprints(spark):
    """A similarity of 0.8 or more links, however far the fingerprints are: two texts here differ at over 19 bits."""
    import random

    from barweave.llm.simhash import NEAR_RADIUS, fingerprint, near_duplicate_components, shingle_set

    random.seed(5)
    for _ in range(20000):
        base = [f"w{random.randrange(10**6)}" for _ in range(22)]
        other = base[:-2] + ["x", "y"]
        a, b = (shingle_set(" ".join(w), 5)[1] for w in (base, other))
        if ((fingerprint(a) ^ fingerprint(b)) % (1 << 64)).bit_count() > NEAR_RADIUS and len(set(a.tolist()) & set(b.tolist())) >= 0.8 * len(set(a.tolist()) | set(b.tolist())):
            break
    else:
        raise AssertionError("no such pair")
    docs = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(other)), (2, " ".join(base[:10]))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicate_components(docs).collect()} == {0: 0, 1: 0, 2: 2}


def test_near_dedup_of_a_large_family_compares_few_pairs(spark, monkeypatch):
    """Copies of one text, most of them less alike than 0.8: as brute force, and few pairs are compared that do not link,
    also where a group spreads over blocks."""
    import random

    from barweave.llm import simhash

    random.seed(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in random.sample(range(150), random.randrange(5)):  # up to four words, 20 shingles
            copy[at] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = [set(simhash.shingle_set(t, 5)[1].tolist()) for _, t in rows]
    alike = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    asked, exact = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda texts, pairs, *more: (asked.append(pairs.distinct().count()), exact(texts, pairs, *more))[1])
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 64)
    component, _ = brute_near_components(rows)
    assert len(set(component.values())) > 30 and 1000 < alike < 0.6 * 300 * 299 / 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()} == component
    assert sum(asked) < alike + 1500


def test_parity_sketches_never_differ_more_than_sets():
    import numpy as np

    from barweave.llm.simhash import parity_sketch

    rng = np.random.default_rng(3)
    for size, apart in ((10, 1), (200, 40), (5000, 900)):
        a = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[apart:], rng.integers(1, 1 << 63, apart, dtype=np.uint64)])
        differ = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(parity_sketch(a), parity_sketch(b)))
        assert 0 < differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_near_dedup_leaves_out_long_texts_that_are_not_alike(spark, monkeypatch):
    """Long texts that share shingles but are less alike than 0.8 are told apart by sketches as long as they are; of the
    texts, only those of likely pairs are sent."""
    import random

    from barweave.llm import simhash

    random.seed(13)
    base = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(12):
        copy = list(base)
        for at in random.sample(range(4000), 240):
            copy[at] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(20, rows[3][1] + " more"), (21, rows[3][1]), (22, " ".join(base[:1500])), (23, " ".join(base[:1400]))]
    asked, exact = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda texts, pairs, *more: (asked.append(pairs.distinct().count()), exact(texts, pairs, *more))[1])
    component, near = brute_near_components(rows)
    assert near > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()} == component
    assert sum(asked) <= near + 3


def test_sketches_laid_over_themselves_are_shorter_sketches():
    import numpy as np

    from barweave.llm.simhash import SKETCH, parity_sketch, shortest_sketch

    grams = np.random.default_rng(5).integers(1, 1 << 63, 3000, dtype=np.uint64)
    long = np.array(parity_sketch(grams))
    places = np.bincount((grams >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    assert len(long) == 64 and shortest_sketch(long.tolist()) == np.packbits(places.astype(np.uint8), bitorder="little").view("<i8").tolist()
    assert [len(parity_sketch(grams[:n])) for n in (0, 1, 256, 257, 512, 513)] == [4, 4, 4, 8, 8, 16]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 26])
def test_apart_leaves_no_wanted_row_behind(spark, monkeypatch, bits):
    from barweave.llm import common

    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = spark.range(30000).selectExpr("xxhash64(id) AS key", "id AS slot", "id AS bits")
    keys = spark.range(0, 30000, 50).selectExpr("xxhash64(id) AS key")
    sure, others = common.apart(rows, "key", keys)
    wanted, found = {r["key"] for r in keys.collect()}, [r["key"] for r in others.collect()]
    assert sure.columns == rows.columns and wanted <= set(found) and not wanted & {r["key"] for r in sure.collect()}
    assert sure.count() + len(found) == 30000 and len(found) < 6000
    assert common.apart(rows, "key", keys.limit(0))[1].count() == 0
