"""Trips and vehicle-days from a stream (K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import vehicle_day
from ..sources.tables import upsert_partitions


def event_time(samples: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp; stored instants are UTC wall clocks."""
    return samples.withColumn("event_time", F.col("timestamp").cast("timestamp"))


def trips(samples: DataFrame, *, stop_minutes: int = 15, late_minutes: int = 60) -> DataFrame:
    """Closed trips: moving samples of a vehicle with gaps below ``stop_minutes``.

    A session window per vehicle, so state is one open trip each; a trip is emitted once the watermark has
    passed its end, and late samples within ``late_minutes`` still extend or join trips.
    """
    moving = event_time(samples).where("speed > 0").withWatermark("event_time", f"{late_minutes} minutes")
    gap = F.session_window("event_time", f"{stop_minutes} minutes")
    return (
        moving.groupBy("veh_id", gap.alias("trip"))
        .agg(
            F.min("event_time").alias("trip_start"),
            F.max("event_time").alias("trip_end"),
            F.count("*").alias("samples"),
            F.min("mileage").alias("init_odo"),
            F.max("mileage").alias("final_odo"),
            F.max("speed").alias("top_speed"),
        )
        .drop("trip")
    )


def refresh_days(samples_path: str, daily_path: str, *, columns: list[str], idle_threshold_minutes: float = 15.0):
    """A foreachBatch function: recompute exactly the vehicle-days a batch touches from the stored samples.

    The sample table is partitioned by ``date``; only the touched dates are read and only their
    partitions of the daily table are rewritten. Other columns of the daily table stay as they are.
    """

    def refresh(batch: DataFrame, _epoch: int) -> None:
        touched = batch.select("veh_id", F.to_date("timestamp").alias("date")).distinct()
        stored = batch.sparkSession.read.parquet(samples_path)
        days = vehicle_day(
            stored.join(touched, ["veh_id", "date"], "left_semi"), idle_threshold_minutes=idle_threshold_minutes
        )
        upsert_partitions(days, daily_path, ["veh_id", "date"], columns=columns)

    return refresh
