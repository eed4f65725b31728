"""Scalar expressions: Column in, Column out, all built in (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the passer value.
PASSER_VALUE = {
    "pass_attempt": -2.2, "complete_pass": 3.7, "passing_yards": 0.2, "pass_touchdown": 11.3, "interception": -14.1,
    "sack": -8.0, "rush_attempt": -1.1, "rushing_yards": 0.6, "rush_touchdown": 15.9,
}


def decay(days: Column, total: float = 160, steepness: float = 3, floor: float = 0.05) -> Column:
    """Recency weight before normalisation: a cubic exponential decay that never falls under the floor."""
    return F.greatest(F.exp(-F.lit(float(steepness)) * F.pow(days / F.lit(float(total)), F.lit(3.0))), F.lit(float(floor)))


def short_name(name: Column) -> Column:
    """'First Last' -> 'F.Last'; null unless there are two words."""
    words = F.split(F.trim(name), r"\s+")
    return F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.lit("."), F.get(words, F.lit(1)))


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+(Jr\.|Sr\.|I{1,3})$", "")


def clock_seconds(text: Column) -> Column:
    """'M:SS' -> seconds; null if it isn't one."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")


def iso_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def iso_date(text: Column) -> Column:
    return F.to_date(iso_timestamp(text))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def round_even(x: Column, places: int = 1) -> Column:
    return F.bround(x, places)


def rounded(x: Column, places: int) -> Column:
    """Half away from zero of the scaled double, as the SQL rounds. F.round goes by the shortest decimal: 0.2621328125, whose double lies below the tie, goes up there."""
    y = x * 10.0**places
    return F.when(F.abs(y) < float("inf"), F.round(y) / 10.0**places).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a zero denominator."""
    return F.try_divide(a, b)


def signed(x: Column, places: int = 1) -> Column:
    """Fixed precision, with '+' before what is above zero."""
    return F.when(x > 0, F.format_string(f"+%.{places}f", x)).otherwise(F.format_string(f"%.{places}f", x))


def report_day(d: Column) -> Column:
    return F.date_format(d, "EEE MM/dd")


def report_time(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")


def keyed_path(prefix: str, key: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), key, F.lit(suffix))


def file_keys(name: Column) -> dict[str, Column]:
    """Keys in a file name `kind_season_week_lookback.ext`."""
    parts = F.split(name, "_")
    return {
        "season": F.get(parts, F.lit(1)).try_cast("int"), "week": F.get(parts, F.lit(2)).try_cast("int"),
        "lookback": F.substring(F.get(parts, F.lit(3)), 1, 2),
    }


def passer_value(columns: dict[str, Column] | None = None) -> Column:
    """The weighted sum of a passer's game; nulls must be filled before."""
    get = columns or {c: F.col(c) for c in PASSER_VALUE}
    out = F.lit(0.0)
    for c, w in PASSER_VALUE.items():
        out = out + F.lit(w) * get[c]
    return out


def pick(diff: Column, home: Column, away: Column) -> Column:
    """The side that the difference favours: home below zero, away above, null at zero or null."""
    return F.when(diff < 0, home).when(diff > 0, away)


def winner(result: Column, line: Column, home: Column, away: Column) -> Column:
    """The side that beat the line; null for a push."""
    return F.when(result < line, away).when(result > line, home)


def flag(condition: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sign_switch(a: Column, b: Column) -> Column:
    """1 if one of the two is negative (or null) and the other isn't."""
    return (F.coalesce(a >= 0, F.lit(False)) != F.coalesce(b >= 0, F.lit(False))).cast("int")


def disagree(a: Column, b: Column) -> Column:
    return flag(a * b < 0)
