"""Date, duration and rounding expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(x + 0.5)


def whole_text(x: Column) -> Column:
    """Text of |x| without decimals."""
    return F.format_string("%.0f", F.abs(x).cast("double"))


def iso_to_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def now_literal(now: datetime | str | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def elapsed_ms(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


def short_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit("—"))


def _text(number: Column, unit: str) -> Column:
    return F.concat(number.cast("string"), F.lit(unit))


def duration_text(ms: Column) -> Column:
    """45s, 3m, 2h 15m, 1d 4h; a dash when missing or negative."""
    sec = half_up(ms / 1000)
    minutes = half_up(sec / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    rest_min = minutes % 60
    rest_hours = hours % 24
    return (
        F.when(ms.isNull() | (ms < 0), "—")
        .when(sec < 60, _text(sec, "s"))
        .when(minutes < 60, _text(minutes, "m"))
        .when(
            hours < 24,
            F.concat(_text(hours, "h"), F.when(rest_min > 0, F.concat(F.lit(" "), _text(rest_min, "m"))).otherwise("")),
        )
        .otherwise(
            F.concat(_text(days, "d"), F.when(rest_hours > 0, F.concat(F.lit(" "), _text(rest_hours, "h"))).otherwise(""))
        )
    )


def relative_age(ts: Column, now: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, 4mo ago, 1y ago."""
    sec = half_up(elapsed_ms(now, ts) / 1000)
    minutes = half_up(sec / 60)
    hours = half_up(minutes / 60)
    days = half_up(hours / 24)
    months = half_up(days / 30)
    return (
        F.when(ts.isNull(), "—")
        .when(sec < 60, "just now")
        .when(minutes < 60, _text(minutes, "m ago"))
        .when(hours < 24, _text(hours, "h ago"))
        .when(days < 30, _text(days, "d ago"))
        .when(months < 12, _text(months, "mo ago"))
        .otherwise(_text(half_up(months / 12), "y ago"))
    )
