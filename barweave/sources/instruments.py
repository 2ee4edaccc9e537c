"""The dimension of instruments: names, exchanges, prices and volumes from quotes, sectors from profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.operators.reports import in_currency

#: Answers of a quote service as they are stored, one JSON object a line; numbers come as texts.
QUOTE = "symbol string, name string, currency string, exchange string, close string, average_volume string, message string"
PROFILE = "symbol string, sector string, industry string"


def instruments(quotes: DataFrame, profiles: DataFrame, currency: str = "USD") -> DataFrame:
    """(ticker, name, currency, exchange, price, avg_volume, sector, industry): a row per symbol that was answered, in the
    currency or in none. An answer with a message is an error and gives no row; a name that lacks is the symbol; prices
    and volumes that are no numbers, and sectors without a profile, are null. Of several answers for a symbol the
    greatest counts."""
    answered = in_currency(quotes.where("symbol is not null and message is null"), "currency", currency)
    rows = answered.select(
        F.col("symbol").alias("ticker"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), "symbol").alias("name"),
        "currency",
        "exchange",
        F.expr("try_cast(close AS double)").alias("price"),
        F.expr("cast(floor(try_cast(average_volume AS double)) AS long)").alias("avg_volume"),
    )
    rest = [c for c in rows.columns if c != "ticker"]
    one = rows.groupBy("ticker").agg(F.max(F.struct(*rest)).alias("_x")).select("ticker", *[F.col("_x")[c].alias(c) for c in rest])
    known = profiles.where("symbol is not null").groupBy(F.col("symbol").alias("ticker")).agg(F.max(F.struct("sector", "industry")).alias("_p"))
    return one.join(known, "ticker", "left").select(*one.columns, F.col("_p.sector").alias("sector"), F.col("_p.industry").alias("industry"))


def read_instruments(spark: SparkSession, quotes: str, profiles: str, currency: str = "USD") -> DataFrame:
    """``instruments`` from folders of stored answers."""
    return instruments(spark.read.schema(QUOTE).json(quotes), spark.read.schema(PROFILE).json(profiles), currency)


def quotes_of_bars(bars: DataFrame, names: DataFrame, days: int = 30) -> DataFrame:
    """Answers of the shape of QUOTE for each ticker of ``names`` (ticker, name) that has bars: the last close, and the mean
    volume of the last ``days`` bars."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))
    last = bars.withColumn("_back", back).where(F.col("_back") <= days).groupBy("ticker").agg(F.max_by("close", "ts").alias("close"), F.avg("volume").alias("volume"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    return last.join(names, "ticker").select(F.col("ticker").alias("symbol"), "name", F.lit("USD").alias("currency"), none.alias("exchange"), text("close").alias("close"), text("volume").alias("average_volume"), none.alias("message"))
