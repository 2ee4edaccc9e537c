import datetime as dt

from pyspark.sql import functions as F

from barweave.functions.scalars import clean_prose
from barweave.operators import reports as H
from barweave.sources.universes import UNIVERSES, universe


def test_prose_loses_field_names(spark):
    cases = [
        ("The trend is up (mtfAligned: true).", "The trend is up."),
        ("Risk is high (strategyWarnings) today", "Risk is high today"),
        ("a trend_pullback setup, not a sma_cross_2", "a trend pullback setup, not a sma cross 2"),
        ("Good (score, confidence: 0.7, riskReward: 2.1) entry", "Good (score, confidence: 0.7) entry"),
        ("Volume  is\t\thigh , really .", "Volume is high, really."),
        ("See (per riskReward and confidenceScore.total) now", "See now"),
        ("Mixed (rsiValue: 55; calm) day", "Mixed (calm) day"),
        ("Keep_This and x_Y and _a_b stay", "Keep_This and x_Y and _a_b stay"),
        ("  padded  ", "padded"),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(clean_prose(F.col("s"))).collect()]
    assert got == [want for _, want in cases]


def test_universes_are_disjoint(spark):
    first, second = universe(spark, "first"), universe(spark, "second")
    assert (first.count(), second.count()) == (81, 72) and first.join(second, "ticker").count() == 0
    assert first.select("sector").distinct().count() == second.select("sector").distinct().count() == 11
    assert list(UNIVERSES["first"]) == list(UNIVERSES["second"])


def test_history_counts_only_what_was_closed_before(spark):
    day = lambda n: dt.date(2024, 1, n)
    trades = [("A", "s", "bull", day(2), 1.0), ("A", "s", "bull", day(5), -1.0), ("B", "s", "bear", day(5), 2.0), ("B", "t", "bull", day(1), 2.0)]
    trades = spark.createDataFrame(trades, "ticker string, strategy string, regime string, exit_ts date, net double")
    found = spark.createDataFrame([("A", day(n), "s", "bull") for n in (1, 2, 3, 6)] + [("B", day(6), "s", None)], "ticker string, ts date, strategy string, regime string")
    rows = H.with_history_as_of(found, trades, least=3).orderBy("ts", "ticker").collect()
    got = [(r["ts"].day, r["regime_trades"], r["regime_win_rate"], r["ticker_trades"], r["strategy_trades"], r["sufficient"]) for r in rows]
    assert got == [(1, 0, None, 0, 0, False), (2, 0, None, 0, 0, False), (3, 1, 1.0, 1, 1, False), (6, 2, 0.5, 2, 3, True), (6, None, None, 1, 3, True)]


def test_news_of_the_last_days(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    items = [("A", i, at(10, i)) for i in range(5)] + [("A", 9, at(2)), ("A", 10, at(3)), ("A", 11, at(11)), ("B", 12, at(10, 3)), ("B", 13, at(10, 3))]
    rows = H.recent_news(spark.createDataFrame(items, "symbol string, id int, ts timestamp"), F.lit(at(10, 5)), most=6)
    assert sorted(r["id"] for r in rows.where("symbol = 'A'").collect()) == [0, 1, 2, 3, 4, 10]
    assert rows.where("symbol = 'B'").count() == 2


def test_instruments_from_stored_answers(spark, tmp_path):
    from barweave.sources.instruments import read_instruments

    quotes = [
        '{"symbol": "A", "name": "Alpha", "currency": "USD", "exchange": "X", "close": "12.5", "average_volume": "1000"}',
        '{"symbol": "B", "currency": null, "close": "", "average_volume": "n/a"}',
        '{"symbol": "C", "currency": "EUR", "close": "1"}',
        '{"symbol": "D", "message": "no such symbol"}',
        '{"message": "limit reached"}',
        '{"symbol": "A", "name": "Alpha", "currency": "USD", "exchange": "X", "close": "12.5", "average_volume": "1000"}',
    ]
    for name, lines in (("q", quotes), ("p", ['{"symbol": "A", "sector": "Tech", "industry": "Chips", "code": 200}', '{"symbol": "Z"}'])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(lines))
    rows = sorted(map(tuple, read_instruments(spark, str(tmp_path / "q"), str(tmp_path / "p")).collect()))
    assert rows == [("A", "Alpha", "USD", "X", 12.5, 1000, "Tech", "Chips"), ("B", "B", None, None, None, None, None, None)]


def test_sector_moves_makes_closes_alone(spark, monkeypatch):
    """No bars are built or stored for the sectors' moves; the closes are those of the bars."""
    from barweave.plans import load
    from barweave.sources import bars as B

    sf = "/root/testdata/sf0.001"
    trades = B.prints(spark, sf, "by_supplier")
    key = lambda df: sorted(map(tuple, df.select("ticker", "ts", "close").collect()))
    assert key(B.walk_closes(trades)) == key(B.walk_bars(trades))

    def stored(*_):
        raise AssertionError("bars were stored")

    monkeypatch.setattr(B, "once", stored)
    assert load()[0]["sector_moves"](spark, sf).count() > 100


def test_line_items_meet_their_parts_and_suppliers_unsorted(spark):
    from barweave.sources import bars as B

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for universe in ("by_type", "by_brand", "by_region"):
            plan = B.walk_closes(B.prints(spark, "/root/testdata/sf0.001", universe))._jdf.queryExecution().sparkPlan().toString()
            meets = [x for x in plan.splitlines() if "Join [l_" in x]
            assert len(meets) == 1 and "ShuffledHashJoin" in meets[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cents_are_what_round_gives(spark):
    from pyspark.sql import functions as F

    from barweave.sources import bars as B

    values = [None, 0.0, 0.05, 0.005, -0.005, 0.0049999999999999994, -0.0049999, 0.015, 0.07, 0.29, 0.57, 1.005, 12.345, -1.115, 2.675, 1e9 + 0.125]
    rows = spark.createDataFrame([(v,) for v in values] + [(i / 1000,) for i in range(-300, 300)], "d double")
    plan = rows.select(B.cents(F.col("d")).alias("c"))
    assert "round" not in plan._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.select(B.cents(F.col("d")).alias("c"), F.round(F.col("d") * 100).cast("long").alias("w")).collect():
        assert r["c"] == r["w"]
