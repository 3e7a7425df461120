"""Fleet overview Q18, Q19, dimension health and series slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHARGER_TYPE, CONNECTOR_TYPE, labels_of_list
from ..sources.tables import located


def overview(fleet: DataFrame, charger: DataFrame) -> DataFrame:
    """Q18: fleets with a position, their granted vehicles, all chargers."""
    return (
        located(fleet)
        .agg(F.count("*").alias("fleets"), F.coalesce(F.sum("zev_grant"), F.lit(0)).alias("granted_zevs"))
        .select("*", charger.agg(F.count("*")).scalar().alias("chargers"))
    )


def vehicle_models(vehicle: DataFrame, fleet_id: int | None = None) -> DataFrame:
    """Q19: vehicles by make, model and year; rows without one of them are not listed (A4)."""
    rows = vehicle if fleet_id is None else vehicle.where(F.col("fleet_id") == fleet_id)
    keys = ["fleet_id", "make", "model", "year"]
    return rows.na.drop(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))


def charger_kinds(charger: DataFrame, fleet_id: int | None = None) -> DataFrame:
    """Q19: chargers by type and connector labels."""
    rows = charger if fleet_id is None else charger.where(F.col("fleet_id") == fleet_id)
    return rows.groupBy(
        "fleet_id",
        labels_of_list(F.col("charger_type"), CHARGER_TYPE).alias("charger_type_label"),
        labels_of_list(F.col("connector_type"), CONNECTOR_TYPE).alias("connector_type_label"),
    ).agg(F.count("*").alias("n"))
