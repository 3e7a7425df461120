"""Star joins and lookups (J-1..J-8, J-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chargers_with_fleet(charger: DataFrame, fleet: DataFrame) -> DataFrame:
    """J-1's dimension side: one row per charger of a known fleet."""
    return charger.join(fleet.select(F.col("id").alias("fleet_id"), "fleet_name"), "fleet_id").withColumnRenamed(
        "id", "charger_id"
    )


def vehicles_with_fleet(vehicle: DataFrame, fleet: DataFrame, how: str = "inner") -> DataFrame:
    """Dimension side of J-2 (``how='left'``) and J-4."""
    return vehicle.join(
        fleet.select(F.col("id").alias("fleet_id"), "fleet_name"), "fleet_id", how
    ).withColumnRenamed("id", "veh_id")


def with_owner_fleet(events: DataFrame, vehicle: DataFrame, charger: DataFrame, fleet: DataFrame) -> DataFrame:
    """J-3: the owner's fleet through the vehicle, else through the charger."""
    v = vehicles_with_fleet(vehicle, fleet, "left").select(
        "veh_id",
        F.col("fleet_id").alias("v_fleet_id"),
        F.col("fleet_name").alias("v_fleet_name"),
        F.col("fleet_vehicle_id").alias("vehicle_label"),
    )
    c = charger.join(fleet.select(F.col("id").alias("fleet_id"), "fleet_name"), "fleet_id", "left").select(
        F.col("id").alias("charger_id"),
        F.col("fleet_id").alias("c_fleet_id"),
        F.col("fleet_name").alias("c_fleet_name"),
        F.col("charger").alias("charger_label"),
    )
    return (
        events.join(v, "veh_id", "left")
        .join(c, "charger_id", "left")
        .withColumns(
            {
                "fleet_id": F.coalesce("v_fleet_id", "c_fleet_id"),
                "fleet_name": F.coalesce("v_fleet_name", "c_fleet_name"),
            }
        )
        .drop("v_fleet_id", "c_fleet_id", "v_fleet_name", "c_fleet_name")
    )


def not_stored(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], *, null_safe: bool = False) -> DataFrame:
    """J-6, U3, U4: incoming rows without a stored match on the keys (nulls equal only if ``null_safe``)."""
    side = stored.select(*[F.col(k).alias(f"__stored_{k}") for k in keys])
    condition = None
    for k in keys:
        a, b = F.col(k), F.col(f"__stored_{k}")
        term = a.eqNullSafe(b) if null_safe else a == b
        condition = term if condition is None else condition & term
    return incoming.join(side, condition, "left_anti")


def with_match_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str = "matched") -> DataFrame:
    """J-7."""
    marked = right.withColumn(flag, F.lit(True))
    return left.join(marked, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def asof_anchor(
    batch: DataFrame, stored: DataFrame, *, key: str = "veh_id", ts: str = "timestamp", value: str = "mileage"
) -> DataFrame:
    """J-8: per key, the newest stored value strictly before the batch's first instant.

    Both sides are read once. The newest of the batch's first instants bounds the scan of the stored side, whose rows meet
    one row per key and are reduced to one row per key and task before they are shuffled for the answer.
    """
    first = batch.groupBy(key).agg(F.min(ts).alias("__first"))
    bound = batch.groupBy(key).agg(F.min(ts).alias("__first")).agg(F.max("__first").alias("bound")).scalar()
    known = stored.where(F.col(value).isNotNull() & (F.col(ts) < bound)).select(key, F.col(ts).alias("__ts"), F.col(value).alias("__v"))
    earlier = known.join(first, key).where("__ts < __first")
    best = earlier.groupBy(key).agg(F.max_by("__v", "__ts").alias("anchor"))
    return first.join(best, key, "left").select(key, F.col("__first").alias("first_ts"), "anchor")


def orphans(facts: DataFrame, key: str, dim: DataFrame, dim_key: str = "id") -> DataFrame:
    """J-10: rows per fact key that no dimension row owns; null keys count as orphans."""
    reduced = facts.groupBy(key).agg(F.count("*").alias("n_rows"))
    return reduced.join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")
