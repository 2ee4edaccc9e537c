"""Scalar helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def r6(x: Column | str) -> Column:
    """Six digits; the shift keeps values of few digits off the ties of rounding."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1.3e-9, 6)


def dto_round(x: Column, digits: int) -> Column:
    """Half up towards plus infinity."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def risk_reward(entry: Column, stop: Column, target: Column) -> Column:
    risk = entry - stop
    return F.when(risk > 0, (target - entry) / risk)


def reward_target(entry: Column, stop: Column, multiple: float) -> Column:
    return entry + multiple * (entry - stop)


def atr_stop(entry: Column, atr: Column, multiple: float) -> Column:
    return entry - multiple * atr


def position_size(equity: Column, risk_pct: float, entry: Column, stop: Column) -> Column:
    """Whole shares that risk ``risk_pct`` of equity; 0 where the stop is not below the entry."""
    return F.when((entry > stop) & (equity > 0), F.floor(equity * risk_pct / (entry - stop))).otherwise(F.lit(0))


def with_slippage(price: Column, bps: float, entry: bool) -> Column:
    return price * (1 + bps / 1e4) if entry else price * (1 - bps / 1e4)


def check_exit(open_: Column, high: Column, low: Column, stop: Column, target: Column) -> Column:
    """struct(reason, price) of the exit on a bar, null without one: the stop first, a gap through it fills at
    the open; then the target."""
    stopped = F.struct(F.lit("stop").alias("reason"), F.when(open_ < stop, open_).otherwise(stop).alias("price"))
    reached = F.struct(F.lit("target").alias("reason"), target.alias("price"))
    return F.when(low <= stop, stopped).when(high >= target, reached)


def session_state(ts: Column) -> Column:
    """Of the New York session at a UTC time."""
    local = F.from_utc_timestamp(ts, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    weekday = F.dayofweek(local).between(2, 6)
    return F.when(~weekday, "closed").when(minute.between(240, 569), "pre").when(minute.between(570, 959), "open").when(minute.between(960, 1199), "post").otherwise("closed")


def in_session_window(ts: Column, start_minute: int, end_minute: int) -> Column:
    """A weekday, from start (included) to end (excluded), in minutes of the Chicago clock."""
    local = F.from_utc_timestamp(ts, "America/Chicago")
    minute = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & (minute >= start_minute) & (minute < end_minute)


def heat_intensity(pct: Column) -> Column:
    return F.least(F.abs(pct) / 4, F.lit(1.0))


def format_price(x: Column) -> Column:
    return F.when(F.abs(x) < 1, F.format_number(x, 4)).otherwise(F.format_number(x, 2))


def format_signed_percent(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.format_number(x, 2), F.lit("%"))


def format_compact(x: Column) -> Column:
    a = F.abs(x)
    out = F.format_number(x, 0)
    for limit, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(a >= limit, F.concat(F.format_number(x / limit, 2), F.lit(mark))).otherwise(out)
    return out


#: White space, as the patterns below understand it.
_S = r"[\s\u000B   -     　﻿]"
#: Names of fields as prose repeats them, and what is left where they are taken out; in this order.
_FIELD_NAME = r"[a-z]+[A-Z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*"
_NOISE = (
    (rf"(?:,{_S}*)?\b{_FIELD_NAME}:{_S}*[^,;)]+(?=[,;)])", ""),
    (rf"\({_S}*(?:(?:per{_S}+)?{_FIELD_NAME}{_S}*(?:,|and)?{_S}*)+\)", ""),
    (rf"\({_S}*[,;]{_S}*", "("),
    (rf"{_S}*\({_S}*\)", ""),
)
_SPACING = ((r"[ \t]{2,}", " "), (rf"{_S}+([.,;:])", "$1"), (rf"^{_S}+|{_S}+$", ""))


def clean_prose(text: Column) -> Column:
    """Prose without the field names that were repeated in it: ``name: value`` pairs and bracketed lists of names go, names
    in snake case become words, and the spacing is mended."""
    for pattern, into in _NOISE:
        text = F.regexp_replace(text, pattern, into)
    # A name in snake case is a whole run of word characters.
    runs = F.regexp_extract_all(text, F.lit(r"\w+|\W+"), F.lit(0))
    words = F.transform(runs, lambda run: F.when(run.rlike(r"^[a-z]+(_[a-z0-9]+)+$"), F.replace(run, F.lit("_"), F.lit(" "))).otherwise(run))
    text = F.array_join(words, "")
    for pattern, into in _SPACING:
        text = F.regexp_replace(text, pattern, into)
    return text
