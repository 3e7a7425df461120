"""Per-entity ordered operators.

Order inside one vehicle is needed, but a vehicle may own a large share of all rows. Each operator
therefore orders rows inside (vehicle, time block), condenses every block to one summary row, orders
the summaries per vehicle, and brings the carried value back by an equi-join on (vehicle, block).
No window over raw rows spans a whole vehicle.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import floor_at_zero, hour_floor, round_to, seconds, time_block
from ..functions.staging import evaluated
from ..functions.zones import LOCAL_TZ, utc_to_local
from ..session import written

# Rows of one vehicle are ordered within blocks of this length. Shorter blocks split a busy vehicle over
# more tasks, longer ones leave fewer block summaries.
BLOCK_MINUTES = 240


def vehicle_day(
    samples: DataFrame,
    *,
    idle_threshold_minutes: float = 15.0,
    slice_minutes: int = BLOCK_MINUTES,
    tz: str | None = None,
) -> DataFrame:
    """One row per (veh_id, date) from (veh_id, timestamp, mileage, soc, speed).

    Between the first and the last moving sample every gap to the next sample counts as drive when the
    sample moves, else as idle. A trip starts with the first moving sample and again with each moving
    sample that ends a stop of at least the threshold; the day's last moving sample opens no trip.
    Samples are ordered per (vehicle, day, slice); the few slice summaries are then chained per day.
    """
    threshold = F.make_dt_interval(mins=F.lit(int(idle_threshold_minutes * 60) // 60), secs=F.lit(idle_threshold_minutes * 60 % 60))
    clock = F.col("timestamp") if tz is None else utc_to_local(F.col("timestamp"), tz)
    minute_of_day = F.hour("__clock") * 60 + F.minute("__clock")
    rows = (
        samples.where(F.col("timestamp").isNotNull())
        .withColumn("__clock", clock)
        .select(
            "veh_id",
            F.to_date("__clock").alias("date"),
            F.floor(minute_of_day / slice_minutes).cast("int").alias("slice"),
            F.col("timestamp").alias("ts"),
            "mileage",
            "soc",
            F.coalesce(F.col("speed") > 0, F.lit(False)).alias("moving"),
        )
    )

    in_slice = Window.partitionBy("veh_id", "date", "slice").orderBy("ts")
    before = in_slice.rowsBetween(Window.unboundedPreceding, -1)
    moving_ts = F.when(F.col("moving"), F.col("ts"))
    ordered = rows.withColumn("succ", F.lead("ts").over(in_slice)).withColumn(
        "stop_from", F.last(F.when(F.col("moving"), F.col("succ")), ignorenulls=True).over(before)
    )
    stop = F.col("ts") - F.col("stop_from")
    opens = F.coalesce(F.col("moving") & (F.col("stop_from") < F.col("ts")) & (stop >= threshold), F.lit(False))
    slices = (
        ordered.withColumn("opens", opens)
        .groupBy("veh_id", "date", "slice")
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min_by("mileage", "ts").alias("first_odo"),
            F.max_by("mileage", "ts").alias("last_odo"),
            F.min_by("soc", F.when(F.col("soc").isNotNull(), F.col("ts"))).alias("first_soc"),
            F.max_by("soc", F.when(F.col("soc").isNotNull(), F.col("ts"))).alias("last_soc"),
            F.min(moving_ts).alias("move_from"),
            F.max(moving_ts).alias("move_to"),
            F.max_by("succ", moving_ts).alias("move_to_succ"),
            F.max_by("opens", moving_ts).alias("last_opens"),
            F.sum(F.when(F.col("moving"), F.col("succ") - F.col("ts"))).alias("drive"),
            F.count_if("opens").alias("opened"),
        )
    )

    by_slice = Window.partitionBy("veh_id", "date").orderBy("slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    chained = slices.withColumn("next_ts", F.lead("first_ts").over(by_slice)).withColumn(
        "out_succ", F.when(F.col("move_to").isNotNull(), F.coalesce("move_to_succ", "next_ts"))
    )
    chained = chained.withColumn("stop_from", F.last("out_succ", ignorenulls=True).over(earlier))
    no_time = F.expr("interval '0' second")
    stop = F.col("move_from") - F.col("stop_from")
    entry_opens = F.coalesce((F.col("stop_from") < F.col("move_from")) & (stop >= threshold), F.lit(False))
    tail = F.when(F.col("move_to_succ").isNull(), F.col("out_succ") - F.col("move_to"))
    chained = chained.select(
        "*",
        entry_opens.alias("entry_opens"),
        (F.coalesce("drive", no_time) + F.coalesce(tail, no_time)).alias("drive_all"),
        (F.col("out_succ") - F.col("move_to")).alias("last_gap"),
        F.when(F.col("move_from") == F.col("move_to"), entry_opens).otherwise(F.col("last_opens")).alias("final_opens"),
    )
    last_soc_slice = F.when(F.col("last_soc").isNotNull(), F.col("slice"))
    days = chained.groupBy("veh_id", "date").agg(
        F.min_by("first_odo", "slice").alias("init_odo"),
        F.max_by("last_odo", "slice").alias("final_odo"),
        F.min_by("first_soc", F.when(F.col("first_soc").isNotNull(), F.col("slice"))).alias("init_soc"),
        F.max_by("last_soc", last_soc_slice).alias("final_soc"),
        F.min("move_from").alias("move_from"),
        F.max("move_to").alias("move_to"),
        F.sum("drive_all").alias("drive_all"),
        F.max_by("last_gap", "move_to").alias("last_gap"),
        (F.sum("opened") + F.count_if("entry_opens")).alias("opened"),
        F.max_by("final_opens", "move_to").alias("final_opens"),
    )
    drive = F.col("drive_all") - F.coalesce("last_gap", no_time)
    idle = (F.col("move_to") - F.col("move_from")) - drive
    moved = F.col("move_to").isNotNull()

    def hours(span: Column) -> Column:
        return F.when(moved, round_to(seconds(span) / 3600, 2)).otherwise(F.lit(0.0))

    trips = 1 + F.col("opened") - F.col("final_opens").cast("int")
    return days.select(
        "veh_id",
        "date",
        F.when(moved, trips).otherwise(F.lit(0)).cast("int").alias("trip_num"),
        "init_odo",
        "final_odo",
        round_to(F.col("final_odo") - F.col("init_odo"), 2).alias("tot_dist"),
        hours(drive).alias("tot_dura"),
        hours(idle).alias("idle_time"),
        "init_soc",
        "final_soc",
        round_to(floor_at_zero(F.col("init_soc") - F.col("final_soc")), 4).alias("tot_soc_used"),
        F.lit(None).cast("double").alias("tot_energy"),
        F.lit(None).cast("int").alias("peak_payload"),
    )


def service_interval(events: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Mean positive odometer step between consecutive services, per vehicle (and ``extra`` groups).

    Steps inside one (vehicle, date) come from a small window; steps across dates from one summary row
    per (vehicle, date).
    """
    keys = [*extra, "veh_id"]
    known = events.where("veh_id is not null and enter_odo is not null and date is not null").select(
        *keys, "date", "id", F.col("enter_odo").cast("double").alias("odo")
    )
    within = Window.partitionBy(*keys, "date").orderBy("id")
    step = F.col("odo") - F.lag("odo").over(within)
    days = (
        known.withColumn("step", step)
        .groupBy(*keys, "date")
        .agg(
            F.min_by("odo", "id").alias("first_odo"),
            F.max_by("odo", "id").alias("last_odo"),
            F.sum(F.when(F.col("step") > 0, F.col("step"))).alias("run"),
            F.count_if(F.col("step") > 0).alias("steps"),
        )
    )
    across = F.col("first_odo") - F.lag("last_odo").over(Window.partitionBy(*keys).orderBy("date"))
    days = days.withColumn("across", F.when(across > 0, across))
    total = F.coalesce(F.sum("run"), F.lit(0.0)) + F.coalesce(F.sum("across"), F.lit(0.0))
    steps = F.sum("steps") + F.count("across")
    return (
        days.groupBy(*keys)
        .agg(total.alias("miles"), steps.alias("steps"))
        .where("steps > 0")
        .select(*keys, (F.col("miles") / F.col("steps")).alias("avg_miles"), "steps")
    )


def monotonic_mileage(
    samples: DataFrame,
    *,
    key: str = "veh_id",
    ts: str = "timestamp",
    raw: str = "mileage_raw",
    out: str = "mileage",
    anchors: DataFrame | None = None,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """Turn a counter that resets into a mileage that never falls.

    Missing readings repeat the previous one (leading ones the first); only positive steps count. With
    ``anchors`` (key, anchor) the series continues from the stored mileage instead of its own start. Rows without a
    key or a time have no place in a series: they stay, with a null mileage.
    """
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    unplaced = samples.where(~placed)
    samples = samples.where(placed)
    keyed = samples.withColumn("__block", time_block(F.col(ts), block_minutes))
    in_block = Window.partitionBy(key, "__block").orderBy(ts)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def steps(frame: DataFrame) -> DataFrame:
        step = F.col(raw) - F.last(raw, ignorenulls=True).over(before)
        return frame.withColumn("__step", F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)))

    has = F.when(F.col(raw).isNotNull(), F.col(ts))
    blocks = (
        steps(keyed.select(key, ts, raw, "__block"))
        .groupBy(key, "__block")
        .agg(
            F.min_by(raw, has).alias("first_raw"),
            F.max_by(raw, has).alias("last_raw"),
            F.sum("__step").alias("run"),
        )
    )
    by_block = Window.partitionBy(key).orderBy("__block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # greatest() skips nulls, so a missing side must be tested for itself
    gap = F.col("first_raw") - F.last("last_raw", ignorenulls=True).over(earlier)
    blocks = blocks.select(
        key,
        "__block",
        "run",
        F.when(gap > 0, gap).otherwise(F.lit(0.0)).alias("__across"),
        F.first("first_raw", ignorenulls=True).over(everything).alias("__start"),
    ).select(
        key,
        "__block",
        "__across",
        "__start",
        F.coalesce(F.sum(F.col("run") + F.col("__across")).over(earlier), F.lit(0.0)).alias("__offset"),
    )
    if anchors is not None:
        blocks = blocks.join(anchors.select(key, F.col("anchor").alias("__anchor")), key, "left").withColumn(
            "__start", F.when(F.col("__start").isNotNull(), F.coalesce("__anchor", "__start"))
        ).drop("__anchor")
    seen = F.last(raw, ignorenulls=True).over(upto).isNotNull()
    rows = steps(keyed).withColumn("__run", F.sum("__step").over(upto)).withColumn("__seen", seen)
    value = F.col("__start") + F.col("__offset") + F.col("__run") + F.when(F.col("__seen"), F.col("__across")).otherwise(0.0)
    filled = (
        rows.join(blocks, [key, "__block"])
        .withColumn(out, value)
        .drop("__block", "__step", "__run", "__seen", "__across", "__start", "__offset")
    )
    return filled.unionByName(unplaced.withColumn(out, F.lit(None).cast(filled.schema[out].dataType)))


def keep_last(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row per key. The rank filter is also applied before the shuffle (window group limit)."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def sample_priority() -> Column:
    """W10 score: moving counts 4, a detail other than ignition 2, a position 1."""
    moving = F.when(F.col("speed") > 0, 4).otherwise(0)
    informative = F.when(F.coalesce(F.contains(F.lower("details"), F.lit("ignition")), F.lit(False)), 0).otherwise(2)
    located = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), 1).otherwise(0)
    return moving + informative + located


def keep_best_sample(df: DataFrame, keys: Sequence[str], *tie_break: Column) -> DataFrame:
    """Best score, then highest speed, then the given tie-break."""
    return keep_last(df, keys, sample_priority().desc(), F.coalesce("speed", F.lit(-1.0)).desc(), *tie_break)


def trajectories(
    points: DataFrame, keys: Sequence[str], ts: str = "timestamp", block_minutes: int = BLOCK_MINUTES
) -> DataFrame:
    """Points numbered along each track; tracks of one point are left out, and so are points of no track, those
    without a full key or a time (``trackless`` gives them).

    Numbers are an offset per (track, block) plus a rank inside the block, so a long track spreads over tasks.
    """
    keyed = points.withColumn("__block", time_block(F.col(ts), block_minutes))
    blocks = keyed.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    blocks = blocks.select(
        *keys,
        "__block",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("points"),
    ).where("points >= 2")
    in_block = Window.partitionBy(*keys, "__block").orderBy(ts)
    return (
        keyed.withColumn("__rank", F.row_number().over(in_block))
        .join(blocks, [*keys, "__block"])
        .withColumn("seq", F.col("__before") + F.col("__rank"))
        .drop("__block", "__rank", "__before")
    )


def trackless(points: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """The points that ``trajectories`` cannot place on any track."""
    missing = F.col(ts).isNull()
    for k in keys:
        missing = missing | F.col(k).isNull()
    return points.where(missing)


def track_pieces(points: DataFrame, keys: Sequence[str], ts: str = "timestamp", piece_points: int = 1000) -> DataFrame:
    """W11 as coordinate lists: each track cut into ordered (lat, lon) lists of at most ``piece_points``."""
    piece = F.sort_array(F.collect_list(F.struct("seq", "latitude", "longitude")))
    number = F.floor((F.col("seq") - 1) / piece_points)
    return (
        trajectories(points, keys, ts)
        .groupBy(*keys, number.alias("piece_no"))
        .agg(piece.alias("piece"))
        .withColumn("positions", F.transform("piece", lambda p: F.struct(p["latitude"], p["longitude"])))
        .drop("piece")
    )


def dense_slot(dim: DataFrame, name: str, slots: int, out: str = "slot") -> DataFrame:
    """Stable series slot of each sorted name. Starts jobs.

    Names are dealt into ranges, numbered inside each range, and shifted by the number of names before the range; only the
    ranges' sizes reach the driver.
    """
    ranged = written(dim.select(name).repartitionByRange(name).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()
    starts = list(accumulate((row.n for row in sizes), initial=0))
    shifts = ranged.sparkSession.createDataFrame([(row["__range"], start) for row, start in zip(sizes, starts)], "__range int, __before long")
    order = Window.partitionBy("__range").orderBy(name)
    rank = F.col("__before") + F.row_number().over(order) - 1
    return ranged.join(F.broadcast(shifts), "__range").select(name, (rank % slots).cast("int").alias(out))


def weekday_hour_minutes(sessions: DataFrame, start: str, end: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Minutes of each session by local weekday (Monday 0) and hour, all 168 cells present.

    A sweep over UTC hours: a session gives its partial first and last hour, +1 where its full hours begin and -1 where they
    end, so at most three rows however long it is. Running sums per year, shifted by the sums of the years before, tell how
    many sessions fill the hours up to the next border; only these stretches of the calendar are cut into hours. The zone's
    offsets are whole hours, so UTC hours are local ones. Sums are whole microseconds in decimals, exact in any order.
    """
    hour, exact = F.expr("interval 1 hour"), "decimal(38,0)"
    full = F.lit(3_600_000_000).cast("decimal(20,0)")

    def border(at: Column, partial: Column, change: int) -> Column:
        return F.struct(at.alias("b"), partial.cast("decimal(20,0)").alias("partial"), F.lit(change).alias("change"))

    def span(a: Column, b: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", a, b)

    s, e = F.col("s"), F.col("e")
    first, last = hour_floor(s), hour_floor(e)
    inside = F.array(border(first, span(s, e), 0))
    across = F.array(border(first, span(s, first + hour), 0), border(first + hour, F.lit(0), 1), border(last, span(last, e), -1))
    borders = (
        sessions.select(F.col(start).alias("s"), F.col(end).alias("e"))
        .where("e > s")
        .select(F.inline(F.when(first == last, inside).otherwise(across)))
        .groupBy("b")
        .agg(F.sum("partial").cast(exact).alias("partial"), F.sum("change").alias("change"))
        .withColumn("year", F.year("b"))
    )
    # One row per calendar year, so the windows over them stay small.
    years = borders.groupBy("year").agg(F.sum("change").alias("change"), F.min("b").alias("first"))
    by_year = Window.partitionBy(F.lit(0)).orderBy("year")
    years = years.select(
        "year", F.coalesce(F.sum("change").over(by_year.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("first").over(by_year).alias("after"),
    )
    in_year = Window.partitionBy("year").orderBy("b")
    swept = borders.withColumns({"active": F.sum("change").over(in_year), "next": F.lead("b").over(in_year)}).join(years, "year")
    swept = swept.select("b", "partial", (F.col("active") + F.col("before")).alias("active"), F.coalesce("next", "after").alias("next"))
    day = F.expr("interval 1 day")
    stretch = swept.where("active > 0").select("b", "next", "active", F.explode(F.sequence(F.col("b"), F.col("next") - hour, day)).alias("d"))
    filled = stretch.select(F.explode(F.sequence(F.col("d"), F.least(F.col("d") + day, F.col("next")) - hour, hour)).alias("b"), (F.col("active").cast("decimal(17,0)") * full).cast(exact).alias("overlap"))
    hours = swept.select("b", F.col("partial").alias("overlap")).unionByName(filled).where("overlap > 0")
    local = utc_to_local(F.col("b"), tz)
    placed = evaluated(hours.select(F.weekday(local).alias("weekday"), F.hour(local).alias("hour"), "overlap"))
    cells = placed.groupBy("weekday", "hour").agg((F.sum("overlap").cast("double") / 60_000_000).alias("m"))
    grid = sessions.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour")
    )
    return grid.join(cells, ["weekday", "hour"], "left").select(
        "weekday", "hour", F.coalesce("m", F.lit(0.0)).alias("minutes")
    )


__all__ = [
    "dense_slot",
    "keep_best_sample",
    "keep_last",
    "monotonic_mileage",
    "sample_priority",
    "service_interval",
    "track_pieces",
    "trackless",
    "trajectories",
    "vehicle_day",
    "weekday_hour_minutes",
]
