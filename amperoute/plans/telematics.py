"""Telematics queries Q15-Q17, Q27 and the vehicle options."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import round_to
from ..operators import mergeable as m
from ..operators.filters import instants_between, where_set, with_position
from ..operators.joins import vehicles_with_fleet
from ..operators.sequences import track_pieces, trajectories, vehicle_day


def vehicle_days(
    tel: DataFrame, vehicle: DataFrame, fleet_ids: Sequence[int] | None = None, *, idle_threshold_minutes: float = 15.0
) -> DataFrame:
    """Q1: vehicle-days of known vehicles, of the given fleets or all; merge with columns=DAILY_VALUES."""
    known = where_set(vehicle, {"fleet_id": list(fleet_ids) if fleet_ids else None}).select(F.col("id").alias("veh_id"))
    return vehicle_day(tel.join(known, "veh_id", "left_semi"), idle_threshold_minutes=idle_threshold_minutes)


def kpis(tel: DataFrame) -> DataFrame:
    """Q15."""
    return tel.agg(
        round_to(F.avg("speed"), 2).alias("avg_speed"),
        round_to(F.max("speed"), 2).alias("max_speed"),
        F.count("*").alias("points"),
    )


def vehicles(vehicle: DataFrame, fleet: DataFrame, fleet_name=None, vehicle_code=None) -> DataFrame:
    return where_set(
        vehicles_with_fleet(vehicle, fleet).select("veh_id", "fleet_id", "fleet_name", "fleet_vehicle_id"),
        {"fleet_name": fleet_name, "fleet_vehicle_id": vehicle_code},
    )


def summary(tel, vehicle, fleet, *, fleet_name=None, vehicle_code=None, start=None, end=None) -> DataFrame:
    """Q16: points with a position, mean and top speed under the filters."""
    parts = {"points": m.count(), "avg_speed": m.mean(F.col("speed")), "max_speed": m.largest(F.col("speed"))}
    rows = with_position(instants_between(tel, "timestamp", start, end))
    known = m.reduce_by_key(rows, ["veh_id"], parts).join(
        vehicles(vehicle, fleet, fleet_name, vehicle_code).select("veh_id"), "veh_id"
    )
    return m.combine(known, [], parts).select(
        "points", round_to(F.col("avg_speed"), 2).alias("avg_speed"), round_to(F.col("max_speed"), 2).alias("max_speed")
    )


def tracks(tel, vehicle, fleet, *, fleet_name=None, vehicle_code=None, start=None, end=None, pieces=False) -> DataFrame:
    """Q17: numbered points of every vehicle's track, or bounded coordinate lists (``pieces``). Labels join last."""
    rows = with_position(instants_between(tel, "timestamp", start, end)).select(
        "veh_id", "timestamp", "latitude", "longitude"
    )
    numbered = (track_pieces if pieces else trajectories)(rows, ["veh_id"])
    return numbered.join(vehicles(vehicle, fleet, fleet_name, vehicle_code).drop("fleet_id"), "veh_id")


def recent_samples(tel, vehicle, fleet, limit: int = 100) -> DataFrame:
    """Q27: the newest samples of known vehicles."""
    return (
        tel.join(vehicles(vehicle, fleet), "veh_id")
        .orderBy(F.col("timestamp").desc(), F.col("veh_id"))
        .limit(limit)
        .select("timestamp", "speed", "fleet_vehicle_id", "fleet_name")
    )


def vehicle_options(vehicle: DataFrame, fleet: DataFrame, fleet_name: str | None = None) -> DataFrame:
    """Q20 for the map page."""
    return vehicles(vehicle, fleet, fleet_name).select("fleet_name", "fleet_vehicle_id").orderBy(
        "fleet_name", "fleet_vehicle_id"
    )
