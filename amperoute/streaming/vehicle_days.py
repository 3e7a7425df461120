"""Vehicle-days from a stream, exact (K5): the rules of W1-W3 as keyed state.

State is one vehicle and day: its samples, kept by Spark's own aggregation until the watermark passes the day's end, then put
in time order and folded by built-in expressions, so no Python call is made per day. So a batch that is replayed after a
failure, or samples that are up to ``late_minutes`` late, give the day that ``operators.sequences.vehicle_day`` gives. Samples
later than that still count while their day is open; behind its end they are left to ``trips.refresh_days``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import floor_at_zero, round_to

# Stored instants are UTC wall clocks; read as UTC in every session zone, so that windows of a day are dates.
_UTC = "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', timestamp), timestamp'1970-01-01 00:00:00Z')"

# ``stop`` is the first sample behind the last moving one; a moving sample that follows a stop of the threshold opens a trip.
_OPENS = "(m.z is not null and coalesce(m.stop, x.ts) < x.ts and x.ts - coalesce(m.stop, x.ts) >= {threshold})"
_FOLD = f"""aggregate(samples,
    named_struct('a', cast(null as long), 'z', cast(null as long), 'stop', cast(null as long), 'drive', 0L, 'opened', 0L, 'last_opens', false),
    (m, x) -> if(not x.moving,
        named_struct('a', m.a, 'z', m.z, 'stop', if(m.z is null, cast(null as long), coalesce(m.stop, x.ts)), 'drive', m.drive, 'opened', m.opened, 'last_opens', m.last_opens),
        named_struct('a', coalesce(m.a, x.ts), 'z', x.ts, 'stop', cast(null as long), 'drive', m.drive + coalesce(coalesce(m.stop, x.ts) - m.z, 0L),
            'opened', m.opened + if({_OPENS}, 1L, 0L), 'last_opens', {_OPENS})))"""


def vehicle_days(samples: DataFrame, *, idle_threshold_minutes: float = 15.0, late_minutes: int = 60) -> DataFrame:
    """One row per vehicle and day of a stream (veh_id, timestamp, mileage, soc, speed), once the watermark has passed the day.

    Samples are unique per vehicle and time. Rows without vehicle or time belong to no day.
    """
    threshold = int(idle_threshold_minutes * 60_000_000)

    def known(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value), value).alias(c)

    rows = samples.where("veh_id is not null and timestamp is not null").withColumn("event_time", F.expr(_UTC)).withWatermark("event_time", f"{late_minutes} minutes")
    rows = rows.select(
        F.col("veh_id").cast("long").alias("veh_id"), F.to_date("timestamp").alias("date"), "event_time",
        F.struct(F.unix_micros("event_time").alias("ts"), known("mileage"), known("soc"), F.coalesce(F.col("speed") > 0, F.lit(False)).alias("moving")).alias("sample"),
    )
    days = rows.groupBy("veh_id", "date", F.window("event_time", "1 day")).agg(F.collect_list("sample").alias("samples"))
    days = days.select("veh_id", "date", F.array_sort("samples").alias("samples"))
    socs = F.filter("samples", lambda x: x["soc"].isNotNull())
    days = days.select(
        "veh_id", "date", F.expr(_FOLD.format(threshold=threshold)).alias("sums"),
        F.get("samples", F.lit(0))["mileage"].alias("init_odo"), F.element_at("samples", -1)["mileage"].alias("final_odo"),
        F.get(socs, F.lit(0))["soc"].alias("init_soc"), F.get(socs, F.size(socs) - 1)["soc"].alias("final_soc"),
    )
    moved, drive = F.col("sums.z").isNotNull(), F.col("sums.drive")
    days = days.select(
        "veh_id", "date", F.when(moved, 1 + F.col("sums.opened") - F.col("sums.last_opens").cast("long")).otherwise(0).alias("trips"), "init_odo", "final_odo",
        drive.alias("drive_us"), F.when(moved, F.col("sums.z") - F.col("sums.a") - drive).otherwise(0).alias("idle_us"), "init_soc", "final_soc",
    )

    def hours(c: str) -> Column:
        return round_to(F.col(c) / 3_600_000_000, 2)

    return days.select(
        "veh_id", "date", F.col("trips").cast("int").alias("trip_num"), "init_odo", "final_odo", round_to(F.col("final_odo") - F.col("init_odo"), 2).alias("tot_dist"),
        hours("drive_us").alias("tot_dura"), hours("idle_us").alias("idle_time"), "init_soc", "final_soc",
        round_to(floor_at_zero(F.col("init_soc") - F.col("final_soc")), 4).alias("tot_soc_used"),
    )


def drained(samples: DataFrame, source: str, out: str, marks: str, **options) -> None:
    """Append ``samples`` to the folder ``source`` and run its stream until nothing is left; run again for what arrives later."""
    samples.write.mode("append").parquet(source)
    spark = samples.sparkSession
    stream = spark.readStream.schema(samples.schema).parquet(source)
    query = vehicle_days(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
