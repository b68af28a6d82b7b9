"""Date/time column expressions (DTM-01..12).  Timestamps are UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens.constants import (
    BAN_WINDOW, DATASET_EPOCH, HOUR_BINS, MORNING_PEAK, NIGHT_PEAK, PRE_DAWN, TRANSITION_HOURS,
)
from roadlens.functions.common import col, first_match, flag, np_round

TWO_PI = 2 * math.pi


def parse_ts(c) -> Column:
    """ISO-8601 text -> timestamp, NULL when unparseable (never raises under ANSI)."""
    return F.try_to_timestamp(col(c))


def cyclical(ts) -> list[Column]:
    """DTM-01: hour/dow/month sin+cos; NULL timestamp -> 0."""
    t = col(ts)
    h, d, m = F.hour(t), F.weekday(t), F.month(t) - 1
    out = []
    for name, v, period in (("hour", h, 24), ("dow", d, 7), ("month", m, 12)):
        ang = F.lit(TWO_PI) * v / F.lit(float(period))
        out.append(F.coalesce(F.sin(ang), F.lit(0.0)).alias(f"{name}_sin"))
        out.append(F.coalesce(F.cos(ang), F.lit(0.0)).alias(f"{name}_cos"))
    return out


def calendar_parts(ts) -> list[Column]:
    """DTM-02: hour, day_of_week (Monday = 0), month; NULL -> -1."""
    t = col(ts)
    return [F.coalesce(F.hour(t), F.lit(-1)).alias("hour"),
            F.coalesce(F.weekday(t), F.lit(-1)).alias("day_of_week"),
            F.coalesce(F.month(t), F.lit(-1)).alias("month")]


def peak_flags(ts) -> list[Column]:
    """DTM-03: weekend, morning peak 4-7, night peak 19-23 (inclusive)."""
    t = col(ts)
    h = F.coalesce(F.hour(t), F.lit(-1))
    return [flag(F.weekday(t) >= 5).alias("is_weekend"),
            flag(h.between(*MORNING_PEAK)).alias("is_morning_peak"),
            flag(h.between(*NIGHT_PEAK)).alias("is_night_peak")]


def lag_minutes(start, created) -> Column:
    """DTM-04: signed minutes from ``start`` to ``created``; NULL -> -1."""
    diff = (F.unix_micros(col(created)) - F.unix_micros(col(start))).cast("double") / F.lit(6e7)
    return F.coalesce(diff, F.lit(-1.0))


def hour_of(ts) -> Column:
    return F.coalesce(F.hour(col(ts)), F.lit(-1))


def hour_bin_label(hour) -> Column:
    """DTM-05: five labelled bins, unknown otherwise."""
    h = col(hour)
    return first_match([(h.between(lo, hi), lab) for lab, lo, hi in HOUR_BINS], "unknown")


def hour_bin_code(hour) -> Column:
    h = col(hour)
    return first_match([(h.between(lo, hi), i) for i, (_, lo, hi) in enumerate(HOUR_BINS)], -1)


def ban_flags(hour) -> list[Column]:
    """DTM-06: daytime ban window, transition hour, pre-dawn."""
    h = col(hour)
    return [flag(h.between(*BAN_WINDOW)).alias("is_daytime_ban_window"),
            flag(h.isin(TRANSITION_HOURS)).alias("is_transition_hour"),
            flag(h.between(*PRE_DAWN)).alias("is_pre_dawn")]


def hour_quadrant(hour) -> Column:
    """DTM-07: floor(h/6) clipped to 0..3 (h = -1 -> 0)."""
    return F.least(F.greatest(F.floor(col(hour) / F.lit(6)), F.lit(0)), F.lit(3)).cast("int")


def month_end_quarter(ts) -> list[Column]:
    """DTM-08: day >= 28 (NULL day counts as 15) and quarter (NULL month counts as 1)."""
    t = col(ts)
    day = F.coalesce(F.dayofmonth(t), F.lit(15))
    month = F.coalesce(F.month(t), F.lit(1))
    return [flag(day >= 28).alias("is_month_end"),
            (F.floor((month - 1) / F.lit(3)) + 1).cast("int").alias("quarter")]


def days_since_epoch(ts, epoch: str = DATASET_EPOCH) -> Column:
    """DTM-09: fractional days since the dataset epoch, 3 dp, NULL -> -1."""
    e = F.unix_micros(F.to_timestamp(F.lit(epoch)))
    d = (F.unix_micros(col(ts)) - e).cast("double") / F.lit(86400e6)
    return F.coalesce(np_round(d, 3), F.lit(-1.0))


def minutes_of_day(ts) -> list[Column]:
    """DTM-10: minutes since midnight (NULL -> -1) and fine sin/cos over 1440 (6 dp)."""
    t = col(ts)
    mins = F.hour(t) * 60 + F.minute(t)
    m0 = F.coalesce(mins, F.lit(0)).cast("double")
    ang = F.lit(TWO_PI) * m0 / F.lit(1440.0)
    return [F.coalesce(mins, F.lit(-1)).alias("time_since_midnight_min"),
            np_round(F.sin(ang), 6).alias("sin_hour_fine"),
            np_round(F.cos(ang), 6).alias("cos_hour_fine")]


def relative_age(ts, now) -> Column:
    """DTM-11: 'Just now' / 'Nm ago' / 'Nh ago' / 'Nd ago' against reference time ``now``."""
    mins = F.floor((F.unix_micros(col(now)) - F.unix_micros(col(ts))) / F.lit(60000000))
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    return (F.when(mins < 1, F.lit("Just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(days.cast("string"), F.lit("d ago"))))


def duration_rollover(start_min, end_min) -> Column:
    """DTM-12: end - start in minutes; a negative span wraps past midnight."""
    d = col(end_min) - col(start_min)
    return F.when(d < 0, d + 1440).otherwise(d)
