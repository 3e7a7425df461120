"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_position


def _as_date(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def where_set(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    *,
    date_column: str = "date",
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """equality or membership for given values, inclusive date range; None means no filter."""
    for column, value in (equals or {}).items():
        if value is None or value == "" or value == []:
            continue
        many = isinstance(value, (list, tuple, set))
        df = df.where(F.col(column).isin(*value) if many else F.col(column) == F.lit(value))
    if start:
        df = df.where(F.col(date_column) >= _as_date(start))
    if end:
        df = df.where(F.col(date_column) <= _as_date(end))
    return df


def instants_between(df: DataFrame, ts: str, start: date | str | None, end: date | str | None) -> DataFrame:
    """F2 on instants: whole last day included, compared on the raw column so it reaches the scan."""
    if start:
        df = df.where(F.col(ts) >= _as_date(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(ts) < F.date_add(_as_date(end), 1).cast("timestamp_ntz"))
    return df


def latest_days(df: DataFrame, column: str = "date", days: int = 30, bounds_of: DataFrame | None = None) -> DataFrame:
    """the last ``days`` days up to the newest date, bound by a scalar subquery (one max, no join)."""
    newest = (bounds_of if bounds_of is not None else df).agg(F.max(column)).scalar()
    return df.where((F.col(column) >= F.date_sub(newest, days - 1)) & (F.col(column) <= newest))


def date_bounds(df: DataFrame, column: str = "date") -> DataFrame:
    """A16."""
    return df.agg(F.min(column).alias("start_date"), F.max(column).alias("end_date"))


def latest_month_bounds(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """newest day and the day 30 days before it."""
    newest = F.to_date(F.max(ts))
    return df.agg(F.date_sub(newest, 30).alias("start_date"), newest.alias("end_date"))


def assets(df: DataFrame, asset_type: str | None, ids: Sequence[int] | None = None) -> DataFrame:
    """vehicle events, or charger events including station-level ones."""
    if asset_type == "vehicle":
        df = df.where("veh_id is not null")
        return df.where(F.col("veh_id").isin(*ids)) if ids else df
    if asset_type == "charger":
        df = df.where("charger_id is not null or maint_ob = 2")
        return df.where(F.col("charger_id").isin(*ids)) if ids else df
    return df


def with_position(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """F7."""
    return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def null_bad_position(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """F8: keep the row, drop a position that is incomplete or out of range."""
    good = valid_position(F.col(lat), F.col(lon))
    return df.withColumns({lat: F.when(good, F.col(lat)), lon: F.when(good, F.col(lon))})


def not_violating(violation: Column) -> Column:
    """A null test result passes, as a range rule says nothing about missing values."""
    return ~F.coalesce(violation, F.lit(False))


def sample_rules(vehicle: str = "veh_id") -> dict[str, Column]:
    """name -> violated, for telematics samples; null measures do not violate."""
    return {
        "missing_timestamp": F.col("timestamp").isNull(),
        "unmapped_vehicle": F.col(vehicle).isNull(),
        "bad_speed": F.col("speed") < 0,
        "bad_soc": (F.col("soc") < 0) | (F.col("soc") > 1),
        "bad_mileage": F.col("mileage") < 0,
    }


def passing(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    for violation in rules.values():
        df = df.where(not_violating(violation))
    return df


def valid_sessions(df: DataFrame, start: str, end: str, minutes: str = "tot_ref_dura", energy: str = "tot_energy") -> DataFrame:
    """F10."""
    return df.where((F.col(end) > F.col(start)) & (F.col(minutes) > 0) & (F.col(energy) > 0))


# Columns a reader adds to each row; they do not make a row non-empty.
PLACE_COLUMNS = ("path", "sheet", "row_no")


def data_rows(df: DataFrame, label: Column | None = None, total: str = "grand total") -> DataFrame:
    """no empty rows, no total row."""
    filled = F.lit(False)
    for name in df.columns:
        if name not in PLACE_COLUMNS:
            filled = filled | F.col(f"`{name}`").isNotNull()
    df = df.where(filled)
    return df if label is None else df.where(not_violating(F.lower(label) == total))


def positive_payload(df: DataFrame) -> DataFrame:
    """F12."""
    return df.where("date is not null and peak_payload > 0")


def dated(df: DataFrame, *columns: str) -> DataFrame:
    """F13."""
    return df.na.drop(subset=list(columns) or ["date"])
