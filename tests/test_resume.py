import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barweave.functions import indicators as I
from barweave.functions import resume
from barweave.functions import structure as S
from barweave.operators import signals as G
from barweave.schema import BARS
from barweave.streaming.rescan import LiveScan

START, TICKERS = dt.date(2008, 1, 1), ("A", "B", "LATE", "RISES", "MARKET")


def _series(seed=5, until=dt.date(2020, 3, 1)):
    """Weekdays of twelve years: walks, one that begins late, one that only rises and so has no swings after its first."""
    rng, rows = random.Random(seed), []
    for ticker in TICKERS:
        close, day = 100.0, START if ticker != "LATE" else dt.date(2019, 6, 3)
        n = 0
        while day < until:
            if day.weekday() < 5:
                n += 1
                before = close
                close = before + 0.25 if ticker == "RISES" and n > 30 else max(5.0, before + rng.choice((-1.5, -0.5, 0.25, 1.0, 0.75)))
                spread = 0.1 if ticker == "RISES" and n > 30 else rng.choice((0.25, 0.5, 1.25))
                rows.append((ticker, day, before, max(before, close) + spread, min(before, close) - spread, close, 1000.0 + rng.randrange(500)))
            day += dt.timedelta(days=1)
    return rows


def _context(bars):
    market = bars.where("ticker = 'MARKET'")
    return G.daily_context(bars, market, "MARKET", market, F.lit("MARKET"))


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-8) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    spark.createDataFrame(_series(), BARS).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.schema(BARS).parquet(path)


def test_rows_from_states_are_those_of_whole_series(spark, series, tmp_path):
    """All columns of the context, from the year states of the bars before a day, against the whole series."""
    day = dt.date(2020, 1, 1)
    resume.year_states(series.where(F.col("ts") < F.lit(day)), 0).write.parquet(str(tmp_path / "states"))
    states = spark.read.schema(resume.STATES).parquet(str(tmp_path / "states"))
    points = resume.starting_points(states, day)
    since = {r["ticker"]: (r["since"], r["carried"] is not None) for r in points.collect()}
    assert since["LATE"] == (dt.date(2019, 6, 3), False)
    assert all(since[t][1] and dt.date(2014, 12, 1) < since[t][0] < dt.date(2016, 1, 1) for t in TICKERS if t != "LATE")
    want = {(r["ticker"], r["ts"]): r.asDict() for r in _context(series).where(F.col("ts") >= F.lit(day)).collect()}
    found = {(r["ticker"], r["ts"]): r.asDict() for r in _context(resume.tails(series, points, day)).where(F.col("ts") >= F.lit(day)).collect()}
    assert found.keys() == want.keys() and len(want) == 5 * 43
    for key, row in want.items():
        assert found[key].keys() == row.keys()
        assert not [(c, row[c], found[key][c]) for c in row if not _same(row[c], found[key][c])], key
    # The one without swings in what was read has those of its state.
    assert want["RISES", dt.date(2020, 2, 28)]["last_sh"] is not None


def test_states_from_tails_are_those_of_whole_series(spark, series, tmp_path):
    """Years that were computed from states leave the same states, also for a ticker that is too short for one."""
    day = dt.date(2019, 1, 1)
    resume.year_states(series.where(F.col("ts") < F.lit(day)), 0).write.parquet(str(tmp_path / "states"))
    points = resume.starting_points(spark.read.schema(resume.STATES).parquet(str(tmp_path / "states")), day)
    flat = lambda df: {(r["ticker"], r["year"]): r.asDict(True) for r in df.collect()}
    found, want = flat(resume.year_states(resume.tails(series, points, day), 2019)), flat(resume.year_states(series, 2019))
    assert found.keys() == want.keys() == {(t, y) for t in TICKERS for y in (2019, 2020)}
    for key, row in want.items():
        for c in ("first_ts", "until", "ts"):
            assert found[key][c] == row[c]
        have, should = found[key]["state"], row["state"]
        assert (have is None) == (should is None)
        for name, value in (should or {}).items():
            same = all(_same(have[name][k], v) for k, v in value.items()) if name == "swings" else _same(have[name], value)
            assert same, (key, name, have[name], value)
    short = flat(resume.year_states(series.where("ticker = 'LATE'").orderBy("ts").limit(4), 0))
    assert short["LATE", 2019]["state"] is None and short["LATE", 2019]["ts"] is None
    assert resume.year_states(series.where("false"), 0).count() == 0


def test_a_live_scan_reads_no_history(spark, tmp_path):
    """Batches of new bars, of a correction five years old, of a new ticker: signals of the whole series each time, and a
    batch at the end reads less than half of the bars."""
    rows = _series()
    read = []

    def scan(bars):
        read.append(bars.count())
        return S.add_structure(I.features_daily(bars)).where("(close > sma200 AND rsi14 > 55) OR trend = 'uptrend'").select("ticker", "ts", F.round("rsi14", 6).alias("score"), "trend")

    live = LiveScan(spark, str(tmp_path / "live"), scan, "score double, trend string", resumes=True)
    cut = dt.date(2019, 12, 1)
    new = [("NEW", r[1], *r[2:]) for r in rows if r[0] == "A" and r[1] >= dt.date(2020, 1, 15)]
    fix = [(r[0], r[1], r[2], r[3] + 9, r[4], r[5] + 8, r[6]) for r in rows if r[:2] == ("B", dt.date(2014, 7, 1))]
    held = {}
    for no, batch in enumerate(([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut], fix, new)):
        held |= {r[:2]: r for r in batch}
        live.handle(spark.createDataFrame(batch, BARS), no)
    want = sorted(map(tuple, scan(spark.createDataFrame(list(held.values()), BARS)).collect()), key=str)
    key = lambda x: (*map(str, x[:2]), x[3])
    found = sorted(map(tuple, live.signals().collect()), key=key)
    want = sorted(want, key=key)
    assert len(found) == len(want) > 1000
    assert all(a[:2] == b[:2] and a[3] == b[3] and _same(round(a[2], 5), round(b[2], 5)) for a, b in zip(found, want))
    assert read[3] < read[0] / 2 and read[2] > read[3]
    # The last batch again, as after a lost driver: nothing changes.
    live.handle(spark.createDataFrame(new, BARS), 3)
    assert sorted(map(tuple, live.signals().collect()), key=key) == found
