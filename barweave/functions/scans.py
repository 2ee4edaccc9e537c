"""Recurrences over the bars of a ticker as segmented scans, so that one long series spreads over many tasks.

Bars are numbered and cut into blocks of BLOCK bars; a block also reads the HALO bars before it, for windows that look back.
A recurrence y[i] = decay * y[i - 1] + b[i] composes to an affine map: what a stretch of bars adds to y is a weighted sum
over its bars, an ordinary aggregate. A window over a row per stretch folds these into the value that each block starts
from, and inside of blocks y is a weighted running sum. All of this is windows, joins and sums of the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a block, and of those before it that it reads. Decays from 0.8 on have decay**-(BLOCK + HALO) as a double,
#: and what a mean of 14 bars forgets in HALO bars is below the rounding of a double.
BLOCK, HALO = 2048, 512


def number_bars(bars: DataFrame, before: tuple[str, ...] = (), bucket: str = "month") -> DataFrame:
    """Adds ``rn``, a bar's number within its ticker from 1, and for each column of ``before`` its value in the bar before
    as ``_before_<column>``. Windows run inside of (ticker, bucket of time); counts and last bars of the buckets are
    handed on. A ticker whose first row has a ``_carried`` state goes on from that state's number."""
    rows = bars.withColumn("_k", F.date_trunc(bucket, "ts"))
    inside, buckets = Window.partitionBy("ticker", "_k").orderBy("ts"), Window.partitionBy("ticker").orderBy("_k")
    held = F.struct(F.lit(1).alias("_one"), *before)
    first = F.max("_carried.rn") if "_carried" in bars.columns else F.max(F.lit(1))
    ends = rows.groupBy("ticker", "_k").agg(F.count("*").alias("_n"), F.max_by(held, "ts").alias("_last"), first.alias("_first"))
    skipped = F.coalesce(F.sum("_n").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    absent = F.coalesce(F.max("_first").over(Window.partitionBy("ticker")) - 1, F.lit(0))
    carried = ends.select("ticker", "_k", (skipped + absent).alias("_skipped"), F.lag("_last").over(buckets).alias("_from_before"))
    number = (F.col("_skipped") + F.col("_i")).cast("int").alias("rn")
    last = F.coalesce("_within", "_from_before")
    numbered = rows.select("*", F.row_number().over(inside).alias("_i"), F.lag(held).over(inside).alias("_within")).join(carried, ["ticker", "_k"])
    return numbered.select(*bars.columns, number, *[last[c].alias(f"_before_{c}") for c in before])


@dataclass(frozen=True)
class Scan:
    """y = decay * y + gain * x, from bar ``start`` on, where it is the sum of the ``n`` values of x up to there, times
    ``seed``; null before. A ``start`` of 0 has no seed: the sum of all. ``x`` is an SQL expression, null counts as 0."""

    x: str
    decay: float
    gain: float
    n: int = 1
    start: int = 0
    seed: float = 1.0

    def weight(self, until: str) -> str:
        """What a bar's value is worth at bar number ``until``, before its gain."""
        return "1D" if self.decay == 1.0 else f"pow({self.decay!r}D, {until} - rn)"

    def share(self, weight: str, until_of_seeds: int) -> str:
        """SQL of what a bar adds, by its weight; ``until_of_seeds`` is the bar number that weights refer to where the
        seed's bars are."""
        own = f"({self.x}) * {self.gain!r}D * {weight}"
        if not self.start:
            return f"coalesce({own}, 0D)"
        seeding = f"({self.x}) * {self.seed * self.decay ** (until_of_seeds - self.start)!r}D"
        return f"coalesce(CASE WHEN rn > {self.start} THEN {own} WHEN rn > {self.start - self.n} THEN {seeding} END, 0D)"


def ema(x: str, n: int, start: int | None = None) -> Scan:
    k = 2 / (n + 1)
    return Scan(x, 1 - k, k, n, start or n, 1 / n)


def wilder_mean(x: str, n: int, start: int) -> Scan:
    return Scan(x, (n - 1) / n, 1 / n, n, start, 1 / n)


def wilder_sum(x: str, n: int, start: int) -> Scan:
    return Scan(x, (n - 1) / n, 1.0, n, start, 1.0)


def running_sum(x: str) -> Scan:
    return Scan(x, 1.0, 1.0)


def _weights(scans: dict[str, Scan], until: str) -> tuple[dict[float, str], list[str]]:
    """A column of weights for each decay: their names and their SQL."""
    names = {decay: f"_w{i}" for i, decay in enumerate(sorted({s.decay for s in scans.values()}))}
    held = {s.decay: s.weight(until) for s in scans.values()}
    return names, [f"{held[decay]} AS {name}" for decay, name in names.items()]


def _shares(rows: DataFrame, scans: dict[str, Scan], names: dict[float, str], until_of_seeds: int) -> dict[str, str]:
    """SQL of what a row adds to each scan. A row with a ``_carried`` state stands for all bars up to it: it adds the value
    that the scan has there."""
    held = set(rows.schema["_carried"].dataType.names) if "_carried" in rows.columns else set()
    own = {name: s.share(names[s.decay], until_of_seeds) for name, s in scans.items()}
    return {name: f"CASE WHEN _carried IS NULL THEN {x} ELSE _carried.{name} * {names[scans[name].decay]} END" if name in held else x for name, x in own.items()}


def starts_of_blocks(numbered: DataFrame, scans: dict[str, Scan], block: int, halo: int) -> DataFrame:
    """(ticker, _block, a column per scan): each y just before the first bar that a block reads. Stretches end there, so
    that every bar counts once."""
    names, weights = _weights(scans, "_until")
    rows = numbered.selectExpr("*", f"floor((rn - 1 + {halo}) / {block}) + 1 AS _block").selectExpr("*", f"_block * {block} - {halo} AS _until")
    shares = [f"{x} AS {name}" for name, x in _shares(rows, scans, names, block - halo).items()]
    sums = [F.expr(f"sum({name})").alias(name) for name in scans]
    ends = rows.selectExpr("*", *weights).selectExpr("ticker", "_block", *shares).groupBy("ticker", "_block").agg(*sums)
    # What a stretch adds is worth decay**block less with each block, until that is no double any more.
    steps = {name: s.decay**block for name, s in scans.items()}
    reach = max(1 if step == 0.0 else math.ceil(-745.0 / math.log(step)) + 1 for step in [0.0, *steps.values()] if step != 1.0)
    order = "OVER (PARTITION BY ticker ORDER BY _block ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    held = f"collect_list(struct({', '.join(scans)})) {order.format(reach - 1)} AS _ends"
    totals = [f"sum({name}) {order.format('UNBOUNDED')} AS _total_{name}" for name, step in steps.items() if step == 1.0]
    folded = [f"_total_{name} AS {name}" if step == 1.0 else f"aggregate(_ends, 0D, (y, end) -> y * {step!r}D + end.{name}) AS {name}" for name, step in steps.items()]
    return ends.selectExpr("ticker", "_block", held, *totals).selectExpr("ticker", "_block", *folded)


def in_blocks(numbered: DataFrame, make: Callable[[DataFrame], DataFrame], scans: dict[str, Scan], block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """``make(rows)`` run in blocks over rows with a column per scan: there ``ticker`` is (ticker, block), so that windows
    and scans by ticker stay inside of a block; ``rn`` is the number within the whole series and ``place`` that within the
    block, 0 or less in its halo. Frames of ``make`` must look back ``halo`` bars at most, and not ahead. Halo rows are
    dropped from what it returns."""
    if any(s.start > block - halo or s.n > s.start > 0 for s in scans.values()) or halo > block:
        raise ValueError("a seed does not lie in the first stretch")
    at = f"floor((rn - 1) / {block})"
    blocks = f"explode(CASE WHEN (rn - 1) % {block} >= {block - halo} THEN array({at}, {at} + 1) ELSE array({at}) END) AS _block"
    # Blocks without a stretch before them start from nothing.
    rows = numbered.selectExpr("*", blocks)
    if scans:
        rows = rows.join(starts_of_blocks(numbered, scans, block, halo).withColumnsRenamed({name: f"_at_{name}" for name in scans}), ["ticker", "_block"], "left")
    scanned = _scanned(rows, scans, f"_block * {block} - {halo}", "ticker, _block", halo, {name: f"_at_{name}" for name in scans})
    keep = [c for c in numbered.columns if c != "ticker"]
    rows = scanned.selectExpr("struct(ticker, _block AS block) AS ticker", f"cast(rn - _block * {block} AS int) AS place", *keep, *scans)
    out = make(rows).where("place >= 1")
    return out.withColumn("ticker", F.col("ticker.ticker")).drop("place")


def scan_in_block(rows: DataFrame, scans: dict[str, Scan], block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Adds a column per scan to rows inside of ``in_blocks``, from the halo's first bar on: for scans that forget within
    the halo, over what other scans gave."""
    return _scanned(rows, scans, f"ticker.block * {block} - {halo}", "ticker", halo, {})


def _scanned(rows: DataFrame, scans: dict[str, Scan], first: str, by: str, halo: int, starts: dict[str, str]) -> DataFrame:
    """``first``: the number of the bar before the first one that a block reads, -halo in the first block."""
    names, weights = _weights(scans, f"({first})")
    order = f"OVER (PARTITION BY {by} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    sums = [f"sum({x}) {order} AS _sum_{name}" for name, x in _shares(rows, scans, names, -halo).items()]
    made = []
    for name, s in scans.items():
        y = f"(_sum_{name} + coalesce({starts.get(name, '0D')}, 0D)) / {names[s.decay]}"
        made.append(f"CASE WHEN rn >= {s.start} THEN {y} END AS {name}")
    return rows.selectExpr("*", *weights).selectExpr("*", *sums).selectExpr(*[f"`{c}`" for c in rows.columns], *made)
