"""Calendars: US holidays, alignment of series by date, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Easter Sunday by integer arithmetic on the year (Gregorian computus)."""
    div = lambda x, n: F.floor(x / n)
    golden, century, rest = year % 19, div(year, 100), year % 100
    moon = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * div(rest, 4) - moon - rest % 4) % 7
    at = moon + sunday - 7 * div(golden + 11 * moon + 22 * sunday, 451) + 114
    return F.make_date(year, div(at, 31).cast("int"), (at % 31 + 1).cast("int"))


#: Holidays by date, observed on the nearest weekday (month, day, first year, name).
BY_DATE = ((1, 1, 0, "New Year"), (6, 19, 2022, "Juneteenth"), (7, 4, 0, "Independence Day"), (12, 25, 0, "Christmas"))
#: Nth weekdays (month, weekday with Sunday 1, n, name).
BY_WEEKDAY = ((1, 2, 3, "Martin Luther King Day"), (2, 2, 3, "Presidents Day"), (9, 2, 1, "Labor Day"), (11, 5, 4, "Thanksgiving"))


def us_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(year, dt, holiday), listed under the year that the holiday belongs to: a Saturday New Year's Day that is
    observed on December 31 stays under its own year."""
    years = spark.range(first, last + 1).select(F.col("id").alias("year"))
    y = F.col("year").cast("int")
    found = []
    for month, day, since, name in BY_DATE:
        d = F.make_date(y, F.lit(month), F.lit(day))
        moved = F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)
        found.append(F.struct(F.when(y >= since, moved).alias("dt"), F.lit(name).alias("holiday")))
    for month, weekday, n, name in BY_WEEKDAY:
        d = F.make_date(y, F.lit(month), F.lit(1))
        found.append(F.struct(F.date_add(d, F.pmod(weekday - F.dayofweek(d), F.lit(7)) + 7 * (n - 1)).alias("dt"), F.lit(name).alias("holiday")))
    may = F.make_date(y, F.lit(5), F.lit(31))
    found.append(F.struct(F.date_sub(may, F.pmod(F.dayofweek(may) - 2, F.lit(7))).alias("dt"), F.lit("Memorial Day").alias("holiday")))
    found.append(F.struct(F.date_sub(easter(y), 2).alias("dt"), F.lit("Good Friday").alias("holiday")))
    return years.select("year", F.explode(F.array(*found)).alias("x")).select("year", "x.*").where("dt is not null")


def trading_days(days: DataFrame, spark: SparkSession) -> DataFrame:
    """The likely trading days among ``days`` (ts): weekdays that are no holiday of their own year."""
    holidays = us_holidays(spark, 1970, 2100)
    own = days.withColumn("year", F.year("ts").cast("long"))
    weekday = own.where(F.dayofweek("ts").between(2, 6))
    return weekday.join(F.broadcast(holidays), (weekday["ts"] == holidays["dt"]) & (weekday["year"] == holidays["year"]), "left_anti").select("ts")  # some 1,300 holidays, a fixed number


def common_dates(bars: DataFrame) -> DataFrame:
    """Dates that every series has."""
    k = bars.select(F.count_distinct("ticker").alias("k"))
    return bars.groupBy("ts").agg(F.count_distinct("ticker").alias("n")).join(F.broadcast(k), F.col("n") == F.col("k")).select("ts")  # one row


def align(bars: DataFrame) -> DataFrame:
    """Bars on common dates only; of repeated dates the last bar stays."""
    latest = bars.groupBy("ticker", "ts").agg(*[F.last(c).alias(c) for c in bars.columns if c not in ("ticker", "ts")]) if "seq" not in bars.columns else bars
    return latest.join(common_dates(bars), "ts", "left_semi")


def alignment_report(bars: DataFrame) -> DataFrame:
    """Per series, how many bars alignment keeps and drops."""
    marked = bars.join(common_dates(bars).withColumn("common", F.lit(True)), "ts", "left")
    return marked.groupBy("ticker").agg(F.count("common").alias("kept"), F.count(F.when(F.col("common").isNull(), 1)).alias("dropped"))


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """(ticker, ts): trading days of the common range on which a series has no bar."""
    spark = bars.sparkSession
    ends = bars.groupBy("ticker").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = ends.agg(F.max("a").alias("a"), F.min("b").alias("b"))
    days = span.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("ts"))
    calendar = trading_days(days, spark).agg(F.collect_list("ts").alias("days"))  # one row, a date for each trading day
    expected = ends.select("ticker").join(F.broadcast(calendar)).select("ticker", F.explode("days").alias("ts"))
    return expected.join(bars, ["ticker", "ts"], "left_anti")
