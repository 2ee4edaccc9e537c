"""Alerts on quotes by an index of thresholds, for tables and for streams.

Of all ticks only records matter: those that set a new extreme of their symbol. The first tick that meets an alert is
the first record at or beyond its threshold, so alerts are looked up among records in the order of values; no tick meets
every alert of its symbol."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.ordered import WIDEST, nearest_at_or_above, value_bucket

#: The kinds of alerts. Each compares a measure with its threshold, both turned so that larger is beyond.
CONDITIONS = {"price_above": ("price", 1.0), "price_below": ("price", -1.0), "change_pct_above": ("change_pct", 1.0), "change_pct_below": ("change_pct", -1.0)}
#: Groups of buckets, of groups and so on, through which streams find alerts: 16**6 exceeds the number of buckets.
FANOUT, LEVELS = 16, 6


def _turned(x: Column, sign: float) -> Column:
    """Null where it is no number; never a negative zero."""
    return F.when(~F.isnan(x), x * sign + 0.0)


def with_change(ticks: DataFrame, closes: DataFrame) -> DataFrame:
    """Ticks with ``change_pct`` against the last close (symbol, close); null without one."""
    rows = ticks.join(closes.select("symbol", F.col("close").alias("_c")), "symbol", "left")
    return rows.withColumn("change_pct", F.try_divide(F.col("price") - F.col("_c"), F.col("_c")) * 100).drop("_c")


def _known_change(ticks: DataFrame) -> DataFrame:
    return ticks if "change_pct" in ticks.columns else ticks.withColumn("change_pct", F.lit(None).cast("double"))


def active(alerts: DataFrame) -> DataFrame:
    """Alerts that can fire, with their turned threshold as ``value``: of a known condition, with a threshold that is a number
    and, if there is a ``status``, active."""
    rows = alerts.where(F.col("status") == "active") if "status" in alerts.columns else alerts
    value = F.coalesce(*[F.when(F.col("condition") == c, _turned(F.col("threshold"), sign)) for c, (_, sign) in CONDITIONS.items()])
    return rows.select("alert_id", "symbol", "condition", "threshold", value.alias("value")).where("value is not null")


def records(ticks: DataFrame, bucket: str = "hour") -> DataFrame:
    """(symbol, condition, value, ts, event_id, price): ticks that exceed all before them of their symbol, for each
    condition. Extremes run inside buckets of time; a window over a row per bucket hands the earlier ones on."""
    rows = _known_change(ticks).select("symbol", "ts", "event_id", "price", "change_pct").withColumn("_k", F.date_trunc(bucket, "ts"))
    rows = rows.withColumns({c: _turned(F.col(m), sign) for c, (m, sign) in CONDITIONS.items()})
    before = Window.partitionBy("symbol", "_k").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("symbol").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    extremes = rows.groupBy("symbol", "_k").agg(*[F.max(c).alias(c) for c in CONDITIONS])
    carried = extremes.select("symbol", "_k", *[F.max(c).over(earlier).alias(f"_{c}") for c in CONDITIONS])
    inside = rows.withColumns({f"{c}_": F.max(c).over(before) for c in CONDITIONS}).join(carried, ["symbol", "_k"])
    # greatest() passes over nulls: the first tick of all is a record.
    new = [F.when(F.coalesce(F.col(c) > F.greatest(f"{c}_", f"_{c}"), F.lit(True)), F.col(c)) for c in CONDITIONS]
    found = F.array(*[F.struct(F.lit(c).alias("condition"), value.alias("value")) for c, value in zip(CONDITIONS, new)])
    out = inside.select("symbol", "ts", "event_id", "price", F.explode(F.filter(found, lambda x: x["value"].isNotNull())).alias("x"))
    return out.select("symbol", "x.*", "ts", "event_id", "price")


def first_hits(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts (alert_id, symbol, condition, threshold) that fire, each with the first tick that meets it: ts, event_id,
    price. Rows: ticks, their records and the distinct thresholds, whatever a symbol has of each."""
    asked = active(alerts)
    keys = ("symbol", "condition")
    hits = nearest_at_or_above(asked.select(*keys, "value").distinct(), records(ticks), keys, "value", ("ts", "event_id", "price"))
    return asked.join(hits, [*keys, "value"]).select("alert_id", *keys, "threshold", "ts", "event_id", "price")


def alert_hits(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert_id, ts, price): when each alert fires first. Alerts on the change read ``change_pct``; without it they do not
    fire."""
    hits = first_hits(ticks, alerts)
    return hits.groupBy("alert_id").agg(F.min("ts").alias("ts"), F.min_by("price", F.struct("ts", "event_id")).alias("price"))


def alert_error(condition: Column, threshold: Column, price: Column) -> Column:
    """Why an alert cannot be set, or null."""
    on_price, on_change = condition.isin("price_above", "price_below"), condition.isin("change_pct_above", "change_pct_below")
    return (
        F.when(~(on_price | on_change) | condition.isNull(), "Unknown kind of alert")
        .when(threshold.isNull() | F.isnan(threshold) | (F.abs(threshold) == float("inf")), "Threshold is no number")
        .when(on_price & (threshold <= 0), "A price threshold must lie above 0")
        .when((condition == "price_above") & (threshold <= price), "The price is there already")
        .when((condition == "price_below") & (threshold >= price), "The price is there already")
        .when(on_change & ((threshold == 0) | (F.abs(threshold) > 100)), "A change must differ from 0 and lie within 100 %")
        .when((condition == "change_pct_above") & (threshold < 0), "A rise needs a positive change")
        .when((condition == "change_pct_below") & (threshold > 0), "A fall needs a negative change")
    )


# --- streams ----------------------------------------------------------------------------------------------


def _new_extremes(rows, extremes: dict[str, float]):
    """Records among rows sorted by time, given the extremes so far (NaN: none), which are updated. ``since`` is the
    extreme that a record exceeds."""
    import numpy as np
    import pandas as pd

    out = []
    for condition, (measure, sign) in CONDITIONS.items():
        value = rows[measure].to_numpy(dtype=float) * sign + 0.0
        top = np.fmax.accumulate(np.concatenate(([extremes[condition]], value)))
        new = (value > top[:-1]) | (np.isnan(top[:-1]) & ~np.isnan(value))
        extremes[condition] = float(top[-1])
        found = rows.loc[new, ["symbol", "ts", "event_id", "price"]]
        out.append(found.assign(condition=condition, value=value[new], since=top[:-1][new]))
    return pd.concat(out)


_RECORD = "symbol string, ts timestamp, event_id long, price double, condition string, value double, since double"


def live_records(ticks: DataFrame) -> DataFrame:
    """The records of a stream of ticks, with the extreme that each exceeds (``since``, null for the first). Tasks first
    drop what is no record among their own rows, so that a hot symbol's state sees few rows; it holds four numbers."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    none = {c: float("nan") for c in CONDITIONS}
    columns = ["symbol", "ts", "event_id", "price", "change_pct"]

    def thin(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            kept = []
            for _, own in rows.sort_values(["ts", "event_id"], kind="stable").groupby("symbol", sort=False):
                kept.append(own.loc[_new_extremes(own, dict(none)).index.unique()])
            yield pd.concat(kept)[columns] if kept else rows[columns]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        extremes = dict(zip(CONDITIONS, state.get)) if state.exists else dict(none)
        found = _new_extremes(rows, extremes)
        state.update(tuple(extremes[c] for c in CONDITIONS))
        yield found[["symbol", "ts", "event_id", "price", "condition", "value", "since"]]

    rows = _known_change(ticks).where("symbol is not null").select(*columns)
    rows = rows.mapInPandas(thin, "symbol string, ts timestamp, event_id long, price double, change_pct double")
    held = ", ".join(f"{c} double" for c in CONDITIONS)
    return rows.groupBy("symbol").applyInPandasWithState(run, _RECORD, held, "append", GroupStateTimeout.NoTimeout)


def live_alerts(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts of a stream, each once. An alert lies between the extreme that exactly one record exceeds and that record,
    so firing once needs no state of its own. Records meet alerts by equality on groups of value buckets: at most two
    groups a level cover what lies between two extremes. Alerts are those known when the stream starts."""
    from barweave.operators.crossing import between_nodes, node_of

    found = live_records(ticks)
    since = F.when(F.col("since").isNull() | F.isnan("since"), 0).otherwise(value_bucket(F.col("since")) + WIDEST)
    spans = found.withColumn("_x", F.explode(between_nodes(since.cast("long"), value_bucket(F.col("value")) + WIDEST, FANOUT, LEVELS)))
    spans = spans.select("symbol", "condition", "value", "since", "ts", "price", "_x.level", "_x.parent", F.col("_x.since").alias("_from"), F.col("_x.until").alias("_to"))
    place = value_bucket(F.col("threshold")) + WIDEST
    index = active(alerts).drop("threshold").withColumnRenamed("value", "threshold").withColumn("_x", F.explode(node_of(place, FANOUT, LEVELS)))
    index = index.select("alert_id", "symbol", "condition", "threshold", "_x.level", "_x.parent", "_x.at")
    met = spans.join(index, ["symbol", "condition", "level", "parent"]).where(F.col("at").between(F.col("_from"), F.col("_to")))
    first = F.col("since").isNull() | F.isnan("since")
    return met.where((F.col("threshold") <= F.col("value")) & (first | (F.col("threshold") > F.col("since")))).select("alert_id", "ts", "price")
