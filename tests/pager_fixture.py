"""A paged source for tests: a bar every interval but at minutes that seven divides, one bar beyond each page's start."""

import datetime as dt

from barweave.sources.paged import INTERVALS


def bars(ticker, interval, start, end):
    step = INTERVALS[interval]
    first = dt.datetime(2024, 1, 1)
    at = first + dt.timedelta(seconds=-(-max((start - first).total_seconds(), 0) // step) * step)
    while at <= end and ticker != "NONE":
        if at.minute % 7:
            yield (at, 1.0, 2.0, 0.5, float(len(ticker)), float(at.minute))
        at += dt.timedelta(seconds=step)


def page(ticker, interval, start, end, limit):
    found = list(bars(ticker, interval, start, end))[::-1][:limit]
    if found and len(found) < limit:
        found.append((start - dt.timedelta(minutes=1), *found[-1][1:]))  # outside of what was asked for
    return found
