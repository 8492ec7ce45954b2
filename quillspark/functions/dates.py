"""Human-readable times as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a minute, an hour and a day; phrases.
MINUTE, HOUR, DAY = 60, 3600, 86_400
NOW, YESTERDAY, BEFORE, TOMORROW, AFTER = "剛剛", "昨天", "前天", "明天", "後天"


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves upwards, also below zero."""
    return F.floor(x + F.lit(0.5))


def _phrase(n: Column, unit: str) -> Column:
    shown = F.abs(n).cast("string")
    return F.concat(shown, F.lit(f" {unit}"), F.when(n > 0, F.lit("後")).otherwise(F.lit("前")))


def relative_time(iso: Column, now: Column) -> Column:
    """How long before or after ``now`` (a timestamp) the ISO time is; '' if it is not a time.

    Within a week a phrase, else the date, with the year if it differs; in the session's time zone.
    """
    then = F.try_to_timestamp(iso)
    off = rounded((F.unix_micros(then) - F.unix_micros(now)) / 1e6)
    size, days = F.abs(off), rounded(off / DAY)
    named = F.when(days == -1, YESTERDAY).when(days == -2, BEFORE).when(days == 1, TOMORROW).when(days == 2, AFTER).otherwise(_phrase(days, "天"))
    dated = F.when(F.year(then) == F.year(now), F.date_format(then, "M月d日")).otherwise(F.date_format(then, "yyyy年M月d日"))
    return (
        F.when(then.isNull(), "")
        .when(size < MINUTE, NOW)
        .when(size < HOUR, _phrase(rounded(off / MINUTE), "分鐘"))
        .when(size < DAY, _phrase(rounded(off / HOUR), "小時"))
        .when(size < 7 * DAY, named)
        .otherwise(dated)
    )


def full_time(iso: Column) -> Column:
    """Date and time for a title; '' if it is not a time."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "yyyy/M/d HH:mm:ss"), F.lit(""))
