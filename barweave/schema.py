"""Column contracts of the tables."""

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("ts", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
TICKS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("symbol", T.StringType()), T.StructField("price", T.DoubleType())])
PRICES = ("open", "high", "low", "close", "volume")
