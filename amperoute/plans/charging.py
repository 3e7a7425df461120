"""Charging queries Q2-Q6."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHARGER_TYPE, label
from ..functions.measures import minutes_between, round_to, soc_gain_points
from ..functions.zones import LOCAL_TZ, utc_to_local
from ..operators import mergeable as m
from ..operators.filters import latest_days, where_set
from ..operators.joins import chargers_with_fleet
from ..operators.sequences import weekday_hour_minutes


def measured(refuel: DataFrame) -> DataFrame:
    """Sessions with resolved durations, start, end and date."""
    start = F.coalesce("refuel_start", "connect_time")
    end = F.coalesce("refuel_end", "disconnect_time")
    return refuel.withColumns(
        {
            "soc_gain": soc_gain_points(F.col("start_soc"), F.col("end_soc")),
            "charging_duration": F.coalesce("tot_ref_dura", minutes_between(F.col("refuel_start"), F.col("refuel_end"))),
            "connecting_duration": minutes_between(F.col("connect_time"), F.col("disconnect_time")),
            "charge_start_time": start,
            "charge_end_time": end,
            "date": F.to_date(F.coalesce(start, end)),
        }
    )


def labelled_chargers(charger: DataFrame, fleet: DataFrame) -> DataFrame:
    """Chargers of known fleets, type as label."""
    return chargers_with_fleet(charger, fleet).select(
        "charger_id", "fleet_name", label(F.col("charger_type"), CHARGER_TYPE).alias("charger_type")
    )


class Scope:
    """Sessions and chargers after the page's filters (F1); with none chosen and ``recent``, the last 30 days."""

    def __init__(
        self,
        refuel: DataFrame,
        charger: DataFrame,
        fleet: DataFrame,
        *,
        fleet_name: str | None = None,
        charger_type: str | None = None,
        start: date | str | None = None,
        end: date | str | None = None,
        recent: bool = False,
    ):
        self.chargers = where_set(
            labelled_chargers(charger, fleet), {"fleet_name": fleet_name, "charger_type": charger_type}
        )
        sessions = where_set(measured(refuel), start=start, end=end)
        if recent and not any([fleet_name, charger_type, start, end]):
            newest = {"date": m.largest(F.col("date"))}
            known = m.reduce_by_key(sessions, ["charger_id"], newest).join(
                self.chargers.select("charger_id"), "charger_id", "left_semi"
            )
            sessions = latest_days(sessions, bounds_of=known)
        self.sessions = sessions

    def aggregate(self, groups: list[str], parts: Mapping[str, m.Part], keys: list = ()) -> DataFrame:
        """Aggregate over sessions of known chargers: per charger (and ``keys``) first, then per group."""
        reduced = m.reduce_by_key(self.sessions, ["charger_id", *keys], parts)
        return m.combine(reduced.join(self.chargers, "charger_id"), groups, parts)


def kpis(scope: Scope) -> DataFrame:
    """Q2."""
    parts = {
        "events": m.count(),
        "avg_energy": m.mean(F.col("tot_energy")),
        "avg_charging_min": m.mean(F.col("charging_duration")),
        "avg_connecting_min": m.mean(F.col("connecting_duration")),
    }
    out = scope.aggregate([], parts)
    return out.select("events", *[round_to(F.col(c), 2).alias(c) for c in list(parts)[1:]])


def summary(scope: Scope) -> DataFrame:
    """Q3: by fleet and charger type; unlabelled types have no row."""
    parts = {
        "events": m.count(F.col("id")),
        "energy_kwh": m.total(F.col("tot_energy")),
        "avg_charging_min": m.mean(F.col("charging_duration")),
        "avg_connecting_min": m.mean(F.col("connecting_duration")),
        "avg_power_kw": m.mean(F.col("avg_power")),
        "avg_soc_gain": m.mean(F.col("soc_gain")),
    }
    groups = ["fleet_name", "charger_type"]
    out = scope.aggregate(groups, parts).na.drop(subset=groups)
    return out.select(
        *groups,
        "events",
        round_to(F.coalesce("energy_kwh", F.lit(0.0)), 2).alias("energy_kwh"),
        *[round_to(F.col(c), 2).alias(c) for c in list(parts)[2:]],
    )


def daily_means(scope: Scope) -> DataFrame:
    """Q4: mean power, charging and connecting minutes per date (A5)."""
    parts = {c: m.mean(F.col(c)) for c in ("avg_power", "charging_duration", "connecting_duration")}
    out = scope.aggregate(["date"], parts, ["date"]).na.drop(subset=["date"])
    return out.select("date", *[round_to(F.col(c), 4).alias(c) for c in parts])


def hourly_starts_ends(scope: Scope, tz: str = LOCAL_TZ) -> DataFrame:
    """Q5: starts and ends by local hour, all 48 cells present (U1, J-9)."""
    moments = scope.sessions.selectExpr(
        "charger_id", "stack(2, 'Start', charge_start_time, 'End', charge_end_time) as (event, at)"
    ).where("at is not null")
    hour = F.hour(utc_to_local(F.col("at"), tz)).alias("hour")
    parts = {"n": m.count()}
    reduced = m.reduce_by_key(moments, ["charger_id", "event", hour], parts)
    counts = m.combine(reduced.join(scope.chargers, "charger_id"), ["event", "hour"], parts)
    grid = scope.sessions.sparkSession.range(24).select(
        F.col("id").cast("int").alias("hour"), F.explode(F.array(F.lit("Start"), F.lit("End"))).alias("event")
    )
    return grid.join(counts, ["event", "hour"], "left").select(
        "event", "hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def weekday_hours(scope: Scope) -> DataFrame:
    """Q6: charging minutes by local weekday and hour."""
    sessions = scope.sessions.join(scope.chargers.select("charger_id"), "charger_id", "left_semi")
    out = weekday_hour_minutes(sessions, "charge_start_time", "charge_end_time")
    return out.select("weekday", "hour", round_to(F.col("minutes"), 4).alias("minutes"))


def options(scope: Scope) -> DataFrame:
    """Q20 for the charging page: sorted fleets and charger types that have sessions."""
    used = scope.chargers.join(scope.sessions.select("charger_id"), "charger_id", "left_semi")
    return (
        used.selectExpr("stack(2, 'fleet', fleet_name, 'charger_type', charger_type) as (option, value)")
        .where("value is not null")
        .distinct()
        .orderBy("option", "value")
    )
