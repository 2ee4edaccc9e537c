"""Interval sets, loading through a store, and merges that may be replayed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barweave.schema import BARS, TICKS
from barweave.sources import bars as B
from barweave.sources import store as S
from barweave.streaming import quotes as Z

DAY = dt.date(2024, 1, 1)


def _day(n):
    return DAY + dt.timedelta(days=n)


def _ranges(spark, rows):
    return spark.createDataFrame([(t, None if a is None else _day(a), None if b is None else _day(b)) for t, a, b in rows], S.RANGES)


def _days(rows):
    return {(r["ticker"], (r["start"] - DAY).days + i) for r in rows for i in range((r["end"] - r["start"]).days + 1)}


@pytest.mark.parametrize("seed", range(4))
def test_ranges_against_sets_of_days(spark, seed):
    random.seed(seed)
    some = lambda n: [(random.choice("ABC"), a := random.randrange(60), a + random.randrange(-2, 12)) for _ in range(n)]
    wanted, held = some(8) + [("D", 0, 3), ("E", 5, None), (None, 1, 2)], some(8 * (seed % 3))
    days = lambda rows: {(t, d) for t, a, b in rows if t and b is not None for d in range(a, b + 1)}
    got = S.subtract_ranges(_ranges(spark, wanted), _ranges(spark, held)).collect()
    assert _days(got) == days(wanted) - days(held)
    whole = sorted((r["ticker"], r["start"], r["end"]) for r in got)
    assert all(a[0] != b[0] or a[2] + dt.timedelta(days=1) < b[1] for a, b in zip(whole, whole[1:]))


def _source(spark, version=1.0):
    """A bar for each day but those that seven divides."""
    rows = [(t, _day(n), *[version] * 4, float(n)) for t in ("A", "B") for n in range(-400, 400) if n % 7]
    return spark.createDataFrame(rows, BARS)


def test_second_load_fetches_and_changes_nothing(spark, tmp_path):
    store, asked = S.BarStore(spark, str(tmp_path / "bars")), []

    def fetch(missing, version=1.0):
        asked.append(sorted((r["ticker"], (r["start"] - DAY).days, (r["end"] - DAY).days) for r in missing.collect()))
        return S.in_ranges(_source(spark, version), missing)

    rows = lambda df: sorted(map(tuple, df.drop("cached_at").collect()))
    first = rows(store.load(_ranges(spark, [("A", 0, 20), ("A", 15, 30)]), fetch))
    assert [r[1] for r in first] == [_day(n) for n in range(31) if n % 7] and asked == [[("A", 0, 30)]]
    assert rows(store.load(_ranges(spark, [("A", 0, 30)]), fetch)) == first and len(asked) == 1
    wide = rows(store.load(_ranges(spark, [("A", -20, 40), ("B", 3, 4)]), fetch))
    assert asked[1] == [("A", -20, -1), ("A", 31, 40), ("B", 3, 4)]
    assert len(wide) == len({r[:2] for r in wide}) == sum(n % 7 != 0 for n in range(-20, 41)) + 2
    assert rows(store.read()) == wide
    # What is too old is fetched again, and the newer bars win.
    fresh = rows(store.load(_ranges(spark, [("A", 0, 30)]), lambda m: fetch(m, 2.0), max_age_hours=0))
    assert [r[:2] for r in fresh] == [r[:2] for r in first] and {r[2] for r in fresh} == {2.0}


def test_a_load_that_broke_before_its_ranges_is_done_again(spark, tmp_path):
    store = S.BarStore(spark, str(tmp_path / "bars"))
    wanted = _ranges(spark, [("A", 1, 6)])
    _source(spark, 3.0).where(F.col("ticker") == "A").withColumn("cached_at", F.lit(dt.datetime(2024, 1, 1))).write.parquet(str(tmp_path / "bars/bars"))
    assert store.missing(wanted).count() == 1
    got = store.load(wanted, lambda missing: S.in_ranges(_source(spark), missing)).collect()
    assert len(got) == 6 and {r["close"] for r in got} == {1.0}


def test_bars_that_are_written_twice_are_read_once(spark, tmp_path):
    path = str(tmp_path / "table")
    B.write_bars(_source(spark), path)
    B.write_bars(_source(spark, 2.0).where(F.col("ticker") == "A"), path)
    rows = B.read_bars(spark, path)
    assert rows.count() == _source(spark).count()
    assert {(r["ticker"], r["close"]) for r in rows.select("ticker", "close").distinct().collect()} == {("A", 2.0), ("B", 1.0)}


# --- merged tables ----------------------------------------------------------------------------------------


def _merged(spark, path):
    return S.MergedTable(spark, path, "ticker string, ts timestamp, close double, volume double", ("ticker", "ts"), "date_format(ts, 'yyyy-MM')")


def test_replayed_and_half_done_batches_change_nothing(spark, tmp_path):
    table = _merged(spark, str(tmp_path / "t"))
    at = lambda month, hour=0: dt.datetime(2024, month, 1, hour)
    batch = lambda rows: spark.createDataFrame(rows, table.schema)
    one, two = [("A", at(1), 1.0, 1.0), ("A", at(2), 2.0, 1.0)], [("A", at(2), 5.0, 2.0), ("B", at(2), 7.0, 1.0), ("B", at(2), 6.0, 1.0)]
    assert table.read().count() == 0
    table.merge(batch(one), 0)
    # A merge whose driver is lost after its files and before its commit:
    spark.createDataFrame([("X", at(2), 0.0, 0.0)], table.schema).withColumn("part", F.lit("2024-02")).write.partitionBy("part").parquet(str(tmp_path / "t/data/version=1"))
    assert sorted(map(tuple, table.read().collect())) == one
    table.merge(batch(two), 1)
    want = [("A", at(1), 1.0, 1.0), ("A", at(2), 5.0, 2.0), ("B", at(2), 7.0, 1.0)]
    assert sorted(map(tuple, table.read().collect())) == want
    table.merge(batch([("Z", at(1), 9.0, 9.0)]), 1)
    assert sorted(map(tuple, table.read().collect())) == want and table.commits() == [0, 1]
    # Only the touched part has files of the new version.
    parts = {p.name for p in (tmp_path / "t/data/version=1").iterdir() if p.name.startswith("part=")}
    assert parts == {"part=2024-02"}


def test_a_stopped_and_restarted_stream_equals_the_batch(spark, tmp_path):
    t0, path = dt.datetime(2024, 1, 30), str(tmp_path / "in")
    rows = [(i, t0 + dt.timedelta(minutes=25 * i), "AB"[i % 2], float(10 + i % 7)) for i in range(240)]
    table = _merged(spark, str(tmp_path / "t"))

    def run(broken):
        def handle(batch, batch_id):
            table.merge(batch, batch_id)
            if broken:
                raise RuntimeError("lost after the commit of the table, before that of the stream")

        bars = Z.live_bars(Z.tick_stream(spark, path, 1), late="1 day").select("ticker", "ts", "close", "volume")
        query = bars.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        except Exception:
            assert broken
        query.stop()

    for no in range(3):
        spark.createDataFrame(rows[no * 80 : no * 80 + 80], TICKS).coalesce(1).write.mode("append").parquet(path)
        run(broken=True)
        run(broken=False)
    want = {tuple(r) for r in Z.live_bars(spark.createDataFrame(rows, TICKS)).select("ticker", "ts", "close", "volume").collect()}
    assert {tuple(r) for r in table.read().collect()} == want and len(want) > 50
