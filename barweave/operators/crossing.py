"""First crossings and extremes over any stretch of bars, by a hierarchy of blocks.

Bars of a ticker are numbered; FANOUT of them make a block, FANOUT blocks a larger one, and so on for LEVELS levels. A node
is the row of a block's parts with their extremes. A search meets a node per level by equality on (ticker, level, parent),
so a stretch of n bars costs O(log n) rows, and the nodes of one ticker lie in many tasks. The topmost node has as
many parts as a ticker has blocks of that size, so no series is too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT, LEVELS = 32, 4


def _parent(level: Column, at: Column, fanout: int, levels: int) -> Column:
    return F.when(level < levels - 1, F.floor(at / fanout)).otherwise(0).cast("long")


def block_nodes(numbered: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(ticker, level, parent, parts): parts are structs (at, low, high), sorted by place, of bars (level 0) or of blocks.
    ``numbered``: ticker, rn (from 1, without gaps), low, high; nulls never cross. Each level is added up inside of
    tasks first; a node has at most ``fanout`` parts but for the topmost ones."""
    places = node_of(F.col("rn") - 1, fanout, levels)
    spread = numbered.select("ticker", "low", "high", F.explode(places).alias("x")).select("ticker", "x.*", "low", "high")
    parts = spread.groupBy("ticker", "level", "parent", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return parts.groupBy("ticker", "level", "parent").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("parts"))


def _ahead(start: Column, fanout: int, levels: int) -> Column:
    """What a search from a place on has to look at: (level, parent, since), a node per level."""
    steps, at = [], start
    for level in range(levels):
        steps.append(F.struct(F.lit(level).alias("level"), _parent(F.lit(level), at, fanout, levels).alias("parent"), at.cast("long").alias("since")))
        at = F.floor(at / fanout) + 1
    return F.array(*steps)


def first_crossing(rows: DataFrame, nodes: DataFrame, key: tuple[str, ...], start: str, lower: str, upper: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key..., hit_rn): for each row the number of the first bar from ``start`` on whose low is at or below ``lower``
    or whose high is at or above ``upper``; rows that never cross are left out, and so are those without a start. A null
    bound is never crossed. ``key`` names rows and has ``ticker``; ``nodes`` are those of ``block_nodes``."""
    crosses = lambda p: (p["low"] <= F.col("_lower")) | (p["high"] >= F.col("_upper"))
    asked = rows.select(*key, F.col(lower).alias("_lower"), F.col(upper).alias("_upper"), F.explode(_ahead(F.col(start) - 1, fanout, levels)).alias("_x"))
    asked = asked.select(*key, "_lower", "_upper", "_x.*")
    met = asked.join(nodes, ["ticker", "level", "parent"])
    first = F.filter("parts", lambda p: (p["at"] >= F.col("since")) & crosses(p))
    met = met.withColumn("at", F.get(first, 0)["at"]).where("at is not null")
    # What lies in a lower level comes first.
    found = met.groupBy(*key).agg(F.min(F.struct("level", "at", "_lower", "_upper")).alias("_x")).select(*key, "_x.*")
    for _ in range(levels - 1):
        # A block holds the bar: on to its parts. Rows that have arrived at a bar pass.
        down = found.withColumn("_open", F.col("level") > 0).withColumn("parent", F.when(F.col("_open"), F.col("at"))).withColumn("level", F.greatest(F.col("level") - 1, F.lit(0)))
        inside = down.join(nodes, ["ticker", "level", "parent"], "left")
        at = F.when(F.col("_open"), F.get(F.filter("parts", crosses), 0)["at"]).otherwise(F.col("at"))
        found = inside.select(*key, "level", at.alias("at"), "_lower", "_upper")
    return found.select(*key, (F.col("at") + 1).alias("hit_rn"))


def between_nodes(start: Column, end: Column, fanout: int, levels: int) -> Column:
    """The nodes that a stretch consists of: (level, parent, since, until), at most two per level."""
    steps, a, b = [], start, end
    for level in range(levels):
        left, right = _parent(F.lit(level), a, fanout, levels), _parent(F.lit(level), b, fanout, levels)
        for parent, wanted in ((left, a <= b), (right, (a <= b) & (left != right))):
            steps.append(F.when(wanted, F.struct(F.lit(level).alias("level"), parent.alias("parent"), a.cast("long").alias("since"), b.cast("long").alias("until"))))
        a, b = F.floor(a / fanout) + 1, F.floor(b / fanout) - 1
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def node_of(at: Column, fanout: int = FANOUT, levels: int = LEVELS) -> Column:
    """Where a place stands in the hierarchy: (level, parent, at), a node per level."""
    steps = []
    for level in range(levels):
        here = F.floor(at / fanout**level).cast("long")
        steps.append(F.struct(F.lit(level).alias("level"), _parent(F.lit(level), here, fanout, levels).alias("parent"), here.alias("at")))
    return F.array(*steps)


def range_extremes(rows: DataFrame, nodes: DataFrame, key: tuple[str, ...], start: str, end: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key..., high, low): the extremes of the bars from ``start`` to ``end``, both included, for each row."""
    asked = rows.select(*key, F.explode(between_nodes(F.col(start) - 1, F.col(end) - 1, fanout, levels)).alias("_x")).select(*key, "_x.*")
    met = asked.join(nodes, ["ticker", "level", "parent"])
    inside = F.filter("parts", lambda p: p["at"].between(F.col("since"), F.col("until")))
    high, low = F.array_max(F.transform(inside, lambda p: p["high"])), F.array_min(F.transform(inside, lambda p: p["low"]))
    return met.select(*key, high.alias("high"), low.alias("low")).groupBy(*key).agg(F.max("high").alias("high"), F.min("low").alias("low"))
