import datetime as dt

import pytest

from barweave.sources import paged as P

from . import pager_fixture as fixture

START, END = dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 3, 22, 15)


@pytest.mark.parametrize("size, most", [(5000, 20), (40, 3), (7, 1)])
def test_all_bars_come_once_whatever_the_pages(spark, size, most):
    rows = P.read_paged(spark, "tests.pager_fixture:page", ["AB", "C", "NONE"], "5min", START, END, page_size=size, max_pages=most)
    got = sorted((r["ticker"], r["ts"], r["close"], r["volume"]) for r in rows.collect())
    want = sorted((t, b[0], b[4], b[5]) for t in ("AB", "C") for b in fixture.bars(t, "5min", START, END))
    assert got == want and len(got) > 1000


def test_no_slice_takes_more_than_its_pages(spark):
    reader = P.PagedBars({"pager": "x:y", "tickers": "A,B", "interval": "1min", "start": START.isoformat(), "end": END.isoformat(), "page_size": "50", "max_pages": "4"}).reader(None)
    slices = reader.partitions()
    assert len(slices) == 2 * -(-((END - START).total_seconds() + 1) // (60 * 200))
    for s in slices:
        assert sum(1 for _ in P.pages(fixture.page, s.ticker, "1min", s.start, s.end, 50)) <= 4 + 1


def test_unknown_intervals_and_no_tickers(spark):
    assert P.read_paged(spark, "tests.pager_fixture:page", [], "1h", START, END).count() == 0
    with pytest.raises(Exception, match="no such interval"):
        P.read_paged(spark, "tests.pager_fixture:page", ["A"], "2h", START, END).collect()
