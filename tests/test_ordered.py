"""Ranks, numbers, deciles and streaks against plain Python, with ties, nulls and values of all sizes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barweave.functions import ordered as R
from barweave.operators import metrics as M
from barweave.operators import research as Q


def _rows(n=900):
    random.seed(12)
    values = [0.0, -0.0, 1.5, 1.5000000001, -3.25, 1e300, -1e300, 1e-12, float("inf"), float("-inf"), None, 88.0, 88.01]
    out = []
    for i in range(n):
        v = random.choice(values) if i % 2 else round(random.gauss(50, 20), 1)
        out.append((random.choice("ab"), v, random.choice(["AA", "AB", "B", "", None]), dt.date(2020, 1, 1) + dt.timedelta(days=random.randrange(800)), i))
    return out


SCHEMA = "k string, v double, s string, d date, i int"


def _key(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("order", [("v", "s", "i"), ("d", "v", "i"), ("s", "d", "i"), ("i",)])
def test_numbers_follow_the_order(spark, order):
    rows = _rows()
    got = {r["i"]: (r["number"], r["total"]) for r in R.with_number(spark.createDataFrame(rows, SCHEMA), ("k",), order).collect()}
    at = {c: i for i, c in enumerate(("k", "v", "s", "d", "i"))}
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: tuple(_key(r[at[c]]) for c in order))
        assert [got[r[4]] for r in own] == [(n, len(own)) for n in range(1, len(own) + 1)]


def test_average_ranks_share_ties(spark):
    rows = _rows()
    got = {r["i"]: r["rank"] for r in R.with_average_rank(spark.createDataFrame(rows, SCHEMA), ("k",), "v", "rank").collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for r in own:
            below, same = sum(_key(x[1]) < _key(r[1]) for x in own), sum(x[1] == r[1] for x in own)
            assert got[r[4]] == below + (same + 1) / 2


@pytest.mark.parametrize("n", [1, 3, 10, 11, 29, 95])
def test_ntile_as_windows_have_it(spark, n):
    df = spark.range(n).select((F.col("id") + 1).alias("i")).withColumn("own", R.ntile(F.col("i"), F.lit(n), 10))
    assert df.selectExpr("i", "own", "ntile(10) OVER (ORDER BY i) AS known").where("own <> known").count() == 0


def test_buckets_never_fall(spark):
    values = [float("-inf"), -1e300, -7.0, -1e-9, -0.0, 0.0, 1e-300, 0.5, 1.0, 1.001, 99.0, 99.1, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, *values])], "i int, v double").select("i", R.value_bucket(F.col("v")).alias("b"))
    found = [r["b"] for r in sorted(df.collect())]
    assert found == sorted(found) and max(map(abs, found)) <= R.WIDEST


@pytest.mark.parametrize("size", [1, 2, 5, 4096])
def test_streaks_over_buckets(spark, size):
    random.seed(size)
    rows = []
    for k, weights in (("a", [3, 3, 1]), ("b", [9, 1, 0]), ("c", [0, 0, 1]), ("d", [1, 0, 0])):
        rows += [(k, i, random.choices([1.5, -2.0, 0.0], weights)[0]) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i int, net double")
    got = {r["k"]: (r["longest_wins"], r["longest_losses"]) for r in M.streaks(df, "k", ("i",), size=size).collect()}
    for k in "abcd":
        best, run, before = {1: 0, -1: 0, 0: 0}, 0, None
        for _, _, net in sorted(r for r in rows if r[0] == k):
            sign = (net > 0) - (net < 0)
            run = run + 1 if sign == before else 1
            before = sign
            best[sign] = max(best[sign], run)
        assert got[k] == (best[1], best[-1])


def test_statistics_of_ranks_with_a_common_value(spark):
    """A third of all values is one value; the area under the curve is that of all pairs."""
    random.seed(3)
    rows = [(random.choice([1.0, random.random() * 4]), random.gauss(0, 1), random.random() < 0.4) for _ in range(300)]
    got = Q.rank_statistics(spark.createDataFrame(rows, "f double, y double, won boolean"), "y", "won", ("f",)).collect()[0]
    pairs = [(a > b) + (a == b) / 2 for a, _, x in rows if x for b, _, z in rows if not z]
    assert got["auc"] == pytest.approx(sum(pairs) / len(pairs), rel=1e-12) and got["n"] == 300
