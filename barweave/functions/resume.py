"""States from which the feature rows of a series go on without its history.

A state stands for all bars of a ticker up to one of them: the value of every recurrence there, the numbers of bars and of
weeks so far, and the swings known LAG bars later. One is kept per ticker and year. To compute the rows from a day on, each
ticker reads its bars from the latest state that lies far enough before that day for every frame that looks back; its first
row carries the state (``_carried``). A ticker without such a state reads its series from the first bar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import indicators as I
from . import scans
from .structure import SWING, add_swings

#: So far back features look: what forgets within a halo, then means of 200 bars and extremes of 60; means of 200 weeks.
LOOKBACK_BARS, LOOKBACK_WEEKS = scans.HALO + 320, 201
#: From here on every recurrence has its seed behind it.
SEEDED = 64
#: A series that starts at a bar shows its own swings from SWING bars later, and knows them after as many again.
LAG = 2 * SWING - 1

_SWINGS = ("last_sh", "prev_sh", "last_sl", "prev_sl")
STATE = T.StructType(
    [
        T.StructField("rn", T.IntegerType()),
        T.StructField("weeks", T.IntegerType()),
        *[T.StructField(name, T.DoubleType()) for name in I._all_scans()],
        T.StructField("swings", T.StructType([T.StructField(name, T.DoubleType()) for name in _SWINGS])),
        T.StructField("first_ts", T.DateType()),
    ]
)
#: A state of a ticker's year: the ticker's first bar, the last bar that the state has seen, the bar it stands at (null,
#: as the state, while the series is too short).
STATES = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("first_ts", T.DateType()),
        T.StructField("until", T.DateType()),
        T.StructField("ts", T.DateType()),
        T.StructField("state", STATE),
    ]
)


def starting_points(states: DataFrame, day: dt.date) -> DataFrame:
    """(ticker, since, carried): where to read from for the rows from ``day`` on. Only states that saw no bar of that day
    or later count, so that bars may be corrected at any age."""
    usable = states.where((F.col("until") < F.lit(day)) & F.col("state").isNotNull()).select("ticker", "ts", "state")
    last = usable.groupBy("ticker").agg(F.max("state.rn").alias("_bars"), F.max("state.weeks").alias("_weeks"))
    far = (F.col("_bars") - F.col("state.rn") >= LOOKBACK_BARS) & (F.col("_weeks") - F.col("state.weeks") >= LOOKBACK_WEEKS)
    best = usable.join(last, "ticker").where(far).groupBy("ticker").agg(F.max_by(F.struct("ts", "state"), "ts").alias("x"))
    known = states.groupBy("ticker").agg(F.min("first_ts").alias("_first")).join(best, "ticker", "left")
    return known.select("ticker", F.least(F.coalesce("x.ts", "_first"), F.lit(day)).alias("since"), F.col("x.state").alias("carried"))


def tails(bars: DataFrame, points: DataFrame, day: dt.date) -> DataFrame:
    """Bars from each ticker's starting point on, with ``_carried`` at it; those of unknown tickers from ``day`` on."""
    placed = bars.join(points, "ticker", "left").where(F.col("ts") >= F.coalesce("since", F.lit(day)))
    return placed.select(*bars.columns, F.when(F.col("ts") == F.col("since"), F.col("carried")).cast(STATE).alias("_carried"))


def year_states(bars: DataFrame, year: int) -> DataFrame:
    """The states (``STATES``) of the years from ``year`` on, from whole series or ``tails``."""
    by, whole = I.by_ticker(), Window.partitionBy("ticker")
    rows = bars if "_carried" in bars.columns else bars.withColumn("_carried", F.lit(None).cast(STATE))
    rows = add_swings(rows).withColumns(
        {
            "_weeks": F.dense_rank().over(whole.orderBy(F.date_trunc("week", "ts"))) + F.coalesce(F.max("_carried.weeks").over(whole) - 1, F.lit(0)),
            "_first": F.coalesce(F.max("_carried.first_ts").over(whole), F.min("ts").over(whole)),
            "year": F.year("ts"),
        }
    )
    rows = rows.withColumns({"_at": F.lag("ts", LAG).over(by), "_weeks": F.lag("_weeks", LAG).over(by)})
    ends = rows.where(F.col("year") >= year).groupBy("ticker", "year").agg(F.max_by(F.struct("_first", F.col("ts").alias("until"), "_at", "_weeks", F.struct(*_SWINGS).alias("swings")), "ts").alias("x"))
    ends = ends.select("ticker", "year", F.col("x._first").alias("first_ts"), "x.until", F.col("x._at").alias("ts"), F.col("x._weeks").alias("weeks"), "x.swings")
    met = ends.join(I.scan_states(bars), ["ticker", "ts"], "left")
    state = F.when(F.col("rn") >= SEEDED, F.struct(*[F.col(f"`{name}`") for name in STATE.fieldNames()])).cast(STATE)
    return met.select("ticker", "year", "first_ts", "until", "ts", state.alias("state"))
