"""Orders over all rows of a key without a task that holds them all.

A value's bucket never falls as the value rises. Windows run inside of (key, bucket); what a bucket needs from the others is
handed on by a window over a row per bucket. Buckets depend on values alone, so a plan that reads them twice, or a task that
is run again, gets the same ones."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets per unit of the logarithm: each spans a thousandth of a value above 1.
FINENESS = 1024
#: Buckets of all doubles lie within this of 0.
WIDEST = 1 << 20


def value_bucket(x: Column, fineness: int = FINENESS) -> Column:
    """A whole number that never falls as a number rises; null comes first and NaN last, as in Spark's order."""
    infinite = F.abs(x) == float("inf")
    size = F.when(infinite, float(WIDEST - 1)).otherwise(F.log1p(F.abs(x)) * fineness)
    return F.when(x.isNull(), -WIDEST).when(F.isnan(x), WIDEST).otherwise(F.floor(F.signum(x) * size)).cast("long")


def order_bucket(df: DataFrame, column: str) -> Column:
    """A bucket that never falls as a column rises: of numbers as above, months of times, beginnings of strings."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.date_trunc("month", column)
    if isinstance(kind, T.StringType):
        return F.substring(column, 1, 2)
    return value_bucket(F.col(column).cast("double"))


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """An equality join in which nulls are equal; of the keys only those of ``left`` stay."""
    named = right.select(*[F.col(c).alias(f"_right{i}") for i, c in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_right{i}")) for i, c in enumerate(keys)]
    return left.join(named, reduce(and_, same)).drop(*[f"_right{i}" for i in range(len(keys))])


def with_number(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], number: str = "number", total: str = "total") -> DataFrame:
    """Adds each row's number from 1 in the ascending ``order`` within ``by``, and how many rows there are.

    Counts by buckets of the first two columns of the order are added up to what lies before them. A common value of the
    first column spreads over the second one's buckets."""
    first = order[0]
    second = order[1] if len(order) > 1 else order[0]
    rows = rows.withColumns({"_b1": order_bucket(rows, first), "_b2": order_bucket(rows, second)})
    fine = (*by, "_b1", first, "_b2")
    counts = rows.groupBy(*fine).agg(F.count("*").alias("_n"))
    coarse = counts.groupBy(*by, "_b1").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*by)
    earlier = (Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(whole.orderBy("_b1").rowsBetween(*earlier)), F.lit(0))
    coarse = coarse.select(*by, "_b1", ahead.alias("_ahead"), F.sum("_n").over(whole).alias(total))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_b1").orderBy(first, "_b2").rowsBetween(*earlier)), F.lit(0))
    offsets = _joined(counts.select(*fine, inside.alias("_inside")), coarse, (*by, "_b1"))
    own = F.row_number().over(Window.partitionBy(*fine).orderBy(*order))
    out = _joined(rows, offsets, fine).withColumn(number, F.col("_ahead") + F.col("_inside") + own)
    return out.drop("_b1", "_b2", "_ahead", "_inside")


def with_average_rank(rows: DataFrame, by: tuple[str, ...], value: str, name: str) -> DataFrame:
    """Adds 1-based ranks of ``value`` within ``by``; ties share their mean. Equal values are counted before anything is
    ordered, so that ties, however many, are one row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_b", order_bucket(counts, value))
    earlier = (Window.unboundedPreceding, -1)
    coarse = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(*earlier)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(*earlier)), F.lit(0))
    ranks = _joined(counts.select(*by, value, "_b", "_n", inside.alias("_inside")), coarse.select(*by, "_b", ahead.alias("_ahead")), (*by, "_b"))
    mean = F.col("_ahead") + F.col("_inside") + (F.col("_n") + 1) / 2
    return _joined(rows, ranks.select(*by, value, mean.alias(name)), (*by, value))


def ntile(number: Column, total: Column, k: int) -> Column:
    """The bucket, from 1 to ``k``, of a number among ``total``: near-equal sizes, the first ones larger by one."""
    size, larger = F.floor(total / k), total % k
    in_larger = larger * (size + 1)
    return F.when(number <= in_larger, F.floor((number - 1) / (size + 1)) + 1).otherwise(larger + F.floor((number - 1 - in_larger) / size) + 1).cast("int")


def nearest_at_or_above(asks: DataFrame, marks: DataFrame, by: tuple[str, ...], value: str, payload: tuple[str, ...]) -> DataFrame:
    """Distinct ``asks`` (by..., value), each with the ``payload`` of the least mark of its key that is not below it; asks
    without one are left out. ``marks`` (by..., value, payload...) are distinct in (by, value)."""
    held = F.struct(*payload).alias("_mark")
    known = marks.select(*by, value, held)
    rows = asks.select(*by, value, F.lit(None).cast(known.schema["_mark"].dataType).alias("_mark")).unionByName(known)
    rows = rows.withColumn("_b", value_bucket(F.col(value)))
    downwards = Window.partitionBy(*by, "_b").orderBy(F.desc(value), F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last("_mark", ignorenulls=True).over(downwards)
    buckets = rows.groupBy(*by, "_b").agg(F.min_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(value))).alias("_least"))
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*by, "_b", F.last("_least", ignorenulls=True).over(above).alias("_carried"))
    found = rows.withColumn("_here", here).where("_mark is null").join(carried, [*by, "_b"])
    found = found.withColumn("_at", F.coalesce("_here", "_carried")).where("_at is not null")
    return found.select(*by, value, *[F.col("_at")[c].alias(c) for c in payload])
