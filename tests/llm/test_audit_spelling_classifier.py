import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import audit, boosting, queries, spelling
from barweave.llm import quality_classifier as classifier
from barweave.llm.fm_index import WordIndex

from .conftest import DATA, pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter interaction audit ---------------------------------------------------------------------------------


def failures(rows):
    """The letters of the filters that each (doc_id, text) fails."""
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = ["A" * (len(words) < 100), "B" * (100 * len(set(words)) < 80 * len(words)), "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))]
        fails += ["D" * bool(set(text) & set("#$%&*|")), "E" * (doc_id is not None and doc_id > least[text])]
        out.append("".join(fails))
    return out


def simulate(docs, letters):
    """Applies the filters in every order, document by document: docs are (part, fails, good, toxic)."""
    rows = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in itertools.permutations(letters):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                fail = [d for d in own if letter in d[1]]
                shapley[letter] += len(gone)
                alone = sum(d[1] == letter for d in own)
                rows[part, "".join(order), step] = [len(left), len(gone), len(fail) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key in rows:
            if key[0] == part:
                rows[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


AUDIT_TEXTS = [None, "", "SHOUT " * 3, "a # b", " ".join(f"w{i}" for i in range(120)), "same " * 130, "É" * 5 + "ABC", " ".join(f"W{i}" for i in range(120)), "x|y", "\n\t "]


def test_audit_against_simulation(spark):
    random.seed(2)
    rows = [(i, random.choice(AUDIT_TEXTS), random.choice(["en", "de", None, ""]), "x", 1.0) for i in range(60)]
    rows += [(None, "a # b", "en", "x", 1.0), (None, None, None, "x", 1.0), (3, rows[3][1], "fr", "x", 1.0), (3, rows[3][1], "fr", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, mask double")
    marks = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 70, 2)] + [(2, 1, 0), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    good, toxic = {d for d, q, _ in marks if q == 1}, {d for d, _, t in marks if t == 1}
    fails = failures([(r[0], r[1]) for r in rows])
    seen = [(r[2] or "", f, r[0] is not None and r[0] in good, r[0] is not None and r[0] in toxic) for r, f in zip(rows, fails)]
    assert audited(audit.filter_interactions(docs, labels)) == simulate(seen, "ABCDE")


def test_audit_of_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_interactions(none, labels).count() == 0
    one = audit.filter_interactions(spark.createDataFrame([(1, "short", "en")], none.schema), labels)
    rows = one.collect()
    assert len(rows) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_audit_of_other_filters_and_large_counts(spark):
    """Counts near 2**40 in neighbouring fields do not run into each other."""
    counted = [("p", m, f, (1 << 40) + 7 * m + f) for m in range(8) for f in range(2)] + [("p", 5, 1, 3), (None, 0, 0, 2)]
    df = spark.createDataFrame(counted, "part string, mask int, flags int, n long")
    got = audited(audit.audit_filters(df, "XYZ", ("lost",)))
    total = {m: sum(n for p, k, _, n in counted if p == "p" and k == m) for m in range(8)}
    assert got["p", "XYZ", 1][:4] == (sum(total[m] for m in range(8) if not m & 1), sum(total[m] for m in range(8) if m & 1), 0, total[1])
    assert got["p", "YXZ", 2][2] == total[3] + total[7] and got["", "ZYX", 3][:2] == (2, 0)
    lost = sum(n for p, k, f, n in counted if p == "p" and k & 4 and not k & 3 and f)
    assert got["p", "YXZ", 3][4] == lost
    by_order = [got["p", "".join(o), o.index("X") + 1] for o in itertools.permutations("XYZ")]
    assert {r[5] for r in by_order} == {sum(r[1] for r in by_order)}
    with pytest.raises(ValueError):
        audit.audit_filters(df, "XX")


# --- spelling variants ----------------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(counts):
    """Neighbours by deleting each letter: two words at one error share a form with one letter less or masked."""
    masks = {}
    for w in counts:
        for i in range(len(w)):
            masks.setdefault(w[:i] + "*" + w[i + 1 :], []).append(w)
    near = {w: set() for w in counts}
    for group in masks.values():
        for u in group:
            near[u].update(v for v in group if v != u)
    for w in counts:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def variants(df):
    return {r["word"]: tuple(r)[1:] for r in df.collect()}


def made_up_docs():
    """Words with slips of every kind, chains of forms, long and hot groups of words, and edges."""
    random.seed(8)
    stems = ["information", "konfiguration", "élégamment", "aaaaaaaa", "straßenbahn", "prefixxx"]
    texts = []
    for stem in stems:
        texts += [stem] * 60
        for _ in range(40):
            i = random.randrange(len(stem))
            texts.append(random.choice([stem[:i] + stem[i + 1 :], stem[:i] + random.choice("aeß") + stem[i:], stem[:i] + random.choice("xyz") + stem[i + 1 :]]))
    texts += ["prefix" + a + b for a in "abcdefgh" for b in "abcdefgh"] * 2
    texts += ["chainedword"] * 400 + ["chainedwora"] * 30 + ["chainedworab"] * 2
    random.shuffle(texts)
    rows = [(i, " ".join(texts[i * 20 : i * 20 + 20]).title()) for i in range(60)]
    rows += [(None, "NullIdentified nullidentified"), (None, None), (7, ""), (8, "x" * 300 + " " + "x" * 301), (9, "x" * 300 + " " + "x" * 301), (9, "日本語日本語日本語 ퟿÷×÷×÷×÷ ÷×÷×÷×÷"), (10, "short words only")]
    return rows


@pytest.mark.parametrize("max_group, shard_rows", [(20_000, 60_000), (4, 50)])
def test_variants_against_brute_force(spark, max_group, shard_rows):
    """With tiny groups, hot ones are split down to single places."""
    rows = made_up_docs()
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int")
    want = brute_variants(brute_words(rows))
    got = variants(spelling.spelling_variants(docs, max_group=max_group, shard_rows=shard_rows))
    assert got == want
    assert any(r[1] != r[0] and r[0] is not None for r in want.values())  # a chain of two forms


def test_variants_of_the_whole_table(spark, docs):
    assert variants(queries.op12_spelling_variants(spark, DATA)) == brute_variants(brute_words(pairs(docs)))


def test_variants_of_no_words(spark, nothing, edge_docs):
    assert spelling.spelling_variants(nothing).count() == 0
    assert variants(spelling.spelling_variants(edge_docs)) == brute_variants(brute_words(pairs(edge_docs)))


def test_groups_are_split_to_their_bound(spark):
    words = spark.createDataFrame([("common" + a + b + c, 2) for a in "abcdefg" for b in "abcdefg" for c in "ab"], "word string, n long")
    groups = spelling.neighbour_groups(words, max_group=10)
    sizes = groups.withColumn("open", F.col("end") - F.col("start")).groupBy("key", "open").count().where("open > 1").agg(F.max("count")).first()[0]
    assert sizes <= 10


def test_index_finds_all_words_at_one_error():
    random.seed(6)
    words = sorted({bytes(random.choices(b"ab\xe9", k=random.randint(2, 7))) for _ in range(150)})
    index = WordIndex(words)
    for length in range(2, 8):
        asks = [w for w in words if len(w) == length]
        if not asks:
            continue
        got = set()
        for start, end in ((length // 2, length), (0, length // 2)):
            i, j = index.near(np.frombuffer(b"".join(asks), dtype=np.uint8).reshape(len(asks), -1), start, end)
            got |= {(asks[a], words[b]) for a, b in zip(i, j)}
        want = set()
        for u in asks:
            want |= {(u, v) for v in words if len(v) == length and sum(a != b for a, b in zip(u, v)) == 1}
            want |= {(u, v) for v in words if len(v) == length + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))}
        assert got == want
    with pytest.raises(ValueError):
        index.near(np.zeros((1, 4), dtype=np.uint8), 0, 4)


# --- quality classifier ---------------------------------------------------------------------------------------


def scores(df):
    return sorted(((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in df.collect()), key=repr)


def test_classifier_is_right_on_held_out_documents(spark, docs):
    data = DATA.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries.op13_quality_classifier(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(judged) > 50 and np.mean([p == q for p, q in judged]) >= 0.97


def test_held_out_labels_teach_nothing(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held_out = classifier.fold(F.col("doc_id")) == 2
    turned = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(classifier.quality_scores(docs, labels)) == scores(classifier.quality_scores(docs, turned))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    assert scores(classifier.quality_scores(docs, labels)) == scores(classifier.quality_scores(other, labels))


def test_scores_of_edges(spark, edge_docs, nothing, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = scores(classifier.quality_scores(edge_docs, labels))
    assert len(rows) == edge_docs.count() and all(0 <= r[2] <= 1 for r in rows)
    by_id = dict((r[0], r[2]) for r in rows)
    assert by_id[0] == by_id[1] and [r[1] for r in rows if r[0] is None] == [False]
    assert classifier.quality_scores(nothing, labels).count() == 0


@pytest.mark.parametrize("marks, share", [([], 0.5), ([(i, 1) for i in range(40)], None), ([(0, 1), (0, 0), (None, 1), (5, None), (6, 7)], 0.5)])
def test_without_two_classes_the_share_is_the_score(spark, edge_docs, marks, share):
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = {r[2] for r in scores(classifier.quality_scores(edge_docs, labels))}
    assert len(found) == 1 and (share is None or found == {share})


def test_training_documents_are_bounded(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    chosen = classifier.training_ids(labels, 500)
    n = chosen.count()
    assert 300 < n <= 500 and chosen.where(classifier.fold(F.col("doc_id")) == 2).count() == 0
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, classifier.training_ids(labels.repartition(7), 500).collect()))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(400, 5))
    rows[:, 4] = np.round(rows[:, 4])
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 4] > 0)).astype(float)
    model = boosting.fit(rows, labels, trees=30, depth=3)

    def walk(x):
        odds = model.prior
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            odds += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-odds))

    found = model.probabilities(rows)
    np.testing.assert_allclose(found, [walk(x) for x in rows], rtol=1e-12)
    assert np.mean((found > 0.5) == labels) > 0.97
    assert np.array_equal(boosting.fit(rows, labels, trees=30, depth=3).leaf, model.leaf)
