import datetime as dt

from barweave.schema import TICKS
from barweave.streaming import alerts as A
from barweave.streaming import quotes as Z
from pyspark.sql import functions as F


def ticks():
    t0 = dt.datetime(2024, 1, 2, 15, 0)
    return [(i, t0 + dt.timedelta(minutes=10 * i), "AB"[i % 2], float(10 + (i // 4) % 3)) for i in range(40)]


def written(spark, tmp_path):
    for no in range(4):
        spark.createDataFrame(ticks()[no * 10 : no * 10 + 10], TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drain(stream, tmp_path, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_live_bars_equal_batch(spark, tmp_path):
    path = written(spark, tmp_path)
    batch = spark.read.schema(TICKS).parquet(path)
    want = {tuple(r) for r in Z.live_bars(batch).collect()}
    drain(Z.live_bars(Z.tick_stream(spark, path, 100), late="1 day"), tmp_path, "bars", "complete")
    assert {tuple(r) for r in spark.table("bars").collect()} == want and want


def test_live_changes_and_alerts(spark, tmp_path):
    path = written(spark, tmp_path)
    drain(Z.live_changes(Z.tick_stream(spark, path, 100)), tmp_path, "changes", "append")
    want = {(r["symbol"], r["ts"], r["price"]) for r in Z.changes(spark.createDataFrame(ticks(), TICKS)).collect()}
    assert {tuple(r) for r in spark.table("changes").collect()} == want
    alerts = spark.createDataFrame([("x", "A", "price_above", 12.0), ("y", "B", "price_below", 5.0), ("z", "B", "price_above", 11.0)], "alert_id string, symbol string, condition string, threshold double")
    drain(A.live_alerts(Z.tick_stream(spark, path, 1), alerts), tmp_path, "fired", "append")
    fired = [r["alert_id"] for r in spark.table("fired").collect()]
    assert sorted(fired) == ["x", "z"]


def test_alert_errors(spark):
    cases = [("price_above", 10.0, 11.0), ("price_above", -1.0, 5.0), ("change_pct_above", 150.0, 5.0), ("price_below", 3.0, 5.0), ("change_pct_above", -2.0, 5.0), ("change_pct_below", 2.0, 5.0), ("change_pct_below", -2.0, 5.0), ("near", 2.0, 5.0), ("price_above", 10.0, None), ("price_below", 10.0, 9.0), ("change_pct_above", 0.0, 5.0)]
    rows = spark.createDataFrame(cases, "c string, t double, p double")
    got = [r[0] is None for r in rows.select(A.alert_error(F.col("c"), F.col("t"), F.col("p"))).collect()]
    assert got == [False, False, False, True, False, False, True, False, True, False, False]


def test_alerts_on_changes_compare_the_change(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 2, 15, i), "A", p) for i, p in enumerate([100.0, 104.0, 106.0, 94.0])], TICKS)
    closes = spark.createDataFrame([("A", 100.0)], "symbol string, close double")
    alerts = spark.createDataFrame([("u", "A", "change_pct_above", 5.0), ("d", "A", "change_pct_below", -5.0), ("x", "A", "other", 1.0), ("p", "A", "price_above", 106.0)], "alert_id string, symbol string, condition string, threshold double")
    got = {r["alert_id"]: r["price"] for r in A.alert_hits(A.with_change(rows, closes), alerts).collect()}
    assert got == {"u": 106.0, "d": 94.0, "p": 106.0}
    assert {r["alert_id"] for r in A.alert_hits(rows, alerts).collect()} == {"p"}  # without a change nothing fires on it


def test_changes_over_buckets(spark):
    t0 = dt.datetime(2024, 1, 1)
    prices = [1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 1.0]
    rows = spark.createDataFrame([(i, t0 + dt.timedelta(hours=11 * i), "A", p) for i, p in enumerate(prices)], TICKS)
    assert [r["event_id"] for r in Z.changes(rows).orderBy("ts").collect()] == [0, 2, 5, 7]


def test_weeks_begin_on_mondays_and_days_follow_a_zone(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 7, 23, 0), "A", 1.0), (2, dt.datetime(2024, 1, 8, 2, 0), "A", 2.0)], TICKS)
    weeks = sorted(r["ts"] for r in Z.live_bars(rows, "1 week").collect())
    assert weeks == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8)]
    days = [r["ts"] for r in Z.live_bars(rows, "1 day", zone="America/New_York").collect()]
    assert days == [dt.datetime(2024, 1, 7)]


def test_new_signals_pass_once_a_day(spark, tmp_path):
    schema = "ticker string, strategy string, ts timestamp, class string"
    rows = [("A", "s", dt.datetime(2024, 1, 2, 15), "BUY"), ("A", "s", dt.datetime(2024, 1, 2, 16), "BUY"), ("A", "s", dt.datetime(2024, 1, 2, 17), "AVOID"), ("B", "s", dt.datetime(2024, 1, 2, 15), "WATCH")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "signals"))
    stream = Z.new_signals(spark.readStream.schema(schema).parquet(str(tmp_path / "signals")))
    drain(stream, tmp_path, "fresh", "append")
    assert sorted(r["ticker"] for r in spark.table("fresh").collect()) == ["A", "B"]


def test_batches_reach_the_handler(spark, tmp_path):
    path, seen = written(spark, tmp_path), []
    query = Z.to_batches(Z.tick_stream(spark, path, 100), lambda df, no: seen.append(df.count()), str(tmp_path / "cp"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 40


def _loop(rows, alerts):
    """The first tick that meets each alert, by trying all ticks."""
    met = {"price_above": lambda p, c, t: p >= t, "price_below": lambda p, c, t: p <= t, "change_pct_above": lambda p, c, t: c >= t, "change_pct_below": lambda p, c, t: c <= t}
    out = {}
    for alert_id, symbol, condition, threshold in alerts:
        for at, event_id, s, price, change in sorted(rows, key=lambda r: (r[0], r[1])):
            measured = change if condition.startswith("change") else price
            if s == symbol and measured is not None and met[condition](price, change, threshold):
                out[alert_id] = (event_id, price)
                break
    return out


def _walks(n=600):
    import random

    random.seed(5)
    t0, price, rows = dt.datetime(2024, 1, 2), {"A": 100.0, "B": 3.0}, []
    for i in range(n):
        s = "AB"[i % 3 == 0]
        price[s] = round(max(price[s] * random.uniform(0.97, 1.03), 0.01), 3)
        # Some ticks at the same time, some without a change.
        rows.append((t0 + dt.timedelta(minutes=7 * (i // 2)), i, s, price[s], None if i % 7 == 0 else round(price[s] - 100, 3)))
    alerts = []
    for s, prices in (("A", range(40, 260, 3)), ("B", (x / 4 for x in range(1, 60)))):
        for p in map(float, prices):
            alerts += [(f"{s}{c}{p}", s, c, p) for c in ("price_above", "price_below", "change_pct_above")]
            alerts.append((f"{s}change_pct_below{p}", s, "change_pct_below", -p))
    return rows, alerts


_QUOTE = "ts timestamp, event_id long, symbol string, price double, change_pct double"
_ALERT = "alert_id string, symbol string, condition string, threshold double"


def test_alerts_by_records_equal_a_loop(spark):
    rows, alerts = _walks()
    want = _loop(rows, alerts)
    hits = A.first_hits(spark.createDataFrame(rows, _QUOTE), spark.createDataFrame(alerts, _ALERT))
    assert {r["alert_id"]: (r["event_id"], r["price"]) for r in hits.collect()} == want
    assert 100 < len(want) < len(alerts)


def test_alerts_that_cannot_fire(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2), 1, "A", float("nan"), None), (dt.datetime(2024, 1, 3), 2, "A", None, 4.0), (dt.datetime(2024, 1, 4), 3, "A", 0.0, 5.0)], _QUOTE)
    alerts = [("low", "A", "price_below", 0.0), ("high", "A", "price_above", 1.0), ("nan", "A", "price_above", float("nan")), ("none", "A", "price_above", None), ("other", "A", "above", 0.0), ("done", "A", "price_below", 5.0)]
    alerts = spark.createDataFrame(alerts, _ALERT).withColumn("status", F.when(F.col("alert_id") == "done", "triggered").otherwise("active"))
    assert [(r["alert_id"], r["event_id"]) for r in A.first_hits(rows, alerts).collect()] == [("low", 3)]


def test_live_alerts_equal_the_batch(spark, tmp_path):
    rows, alerts = _walks()
    for no in range(4):
        spark.createDataFrame(rows[no * 150 : no * 150 + 150], _QUOTE).repartition(2).write.mode("append").parquet(str(tmp_path / "quotes"))
    stream = spark.readStream.schema(_QUOTE).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "quotes"))
    drain(A.live_alerts(stream, spark.createDataFrame(alerts, _ALERT)), tmp_path, "hits", "append")
    got = [(r["alert_id"], r["price"]) for r in spark.table("hits").collect()]
    assert len(got) == len(set(got)) and dict(got) == {k: price for k, (_, price) in _loop(rows, alerts).items()}
