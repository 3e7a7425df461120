"""Arithmetic on measures: rounding, durations, costs, efficiency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column, digits: int) -> Column:
    """Display precision, decided on the decimal value so binary noise cannot move a tie."""
    return F.round(x.cast("decimal(28,8)"), digits).cast("double")


def half_even_int(x: Column) -> Column:
    """C14: nearest whole number, ties to even."""
    return F.bround(x.cast("decimal(28,8)"), 0).cast("int")


def seconds(span: Column) -> Column:
    """A day-time interval as exact seconds; no session zone is involved."""
    return span.cast("interval second").cast("decimal(20,6)").cast("double")


def minutes_between(start: Column, end: Column) -> Column:
    """C12."""
    return seconds(end - start) / F.lit(60.0)


def minutes_to_hours(x: Column) -> Column:
    """C11."""
    return round_to(x / 60, 2)


def average_power(energy_kwh: Column, minutes: Column) -> Column:
    """C20: mean kW of a session; unknown when the session has no length."""
    return F.when(minutes > 0, round_to(energy_kwh * 60 / minutes, 2))


def soc_gain_points(start_soc: Column, end_soc: Column) -> Column:
    """Gain in percentage points."""
    return end_soc * 100 - start_soc * 100


def total_cost(parts: Column, labor: Column, extra: Column) -> Column:
    """Null-propagating, so it exists only where all three costs do."""
    return parts + labor + extra


def floor_at_zero(x: Column) -> Column:
    """greatest() skips nulls, a missing value must stay missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0).cast("double")))


def energy_per_mile(distance: Column, energy: Column, reported: Column | None = None) -> Column:
    """Reported efficiency wins; only rows of at least 10 miles count."""
    computed = F.when(energy > 0, F.try_divide(energy, distance))
    value = computed if reported is None else F.coalesce(reported, computed)
    return F.when(distance >= 10, value)


def hour_floor(ts: Column) -> Column:
    """Start of the clock hour of a zone-less timestamp, without touching the session zone."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.date_part(F.lit("SECOND"), ts))


def time_block(ts: Column, minutes: int) -> Column:
    """Start of the block of ``minutes`` within the day; a date when blocks are whole days."""
    day = F.to_date(ts)
    if minutes >= 1440:
        return day
    number = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=number * minutes)
