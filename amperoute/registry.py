"""Every registered query: name -> (Tables -> DataFrame)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions import parse as p
from .functions.measures import round_to
from .functions.zones import local_to_utc, localize_in_row_order
from .operators import filters, joins, merge, ordered_fold, sequences
from .operators.conform import fill_dimension, rekey, resolve_key
from .plans import charging, fleet, health, loads, maintenance, telematics, usage
from .schema import DAILY_VALUES
from .session import ensure_checkpoint_dir, prepare
from .sources import sheets
from .sources.views import Tables
from .streaming import vehicle_days

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Query):
        return lambda spark, folder: f(Tables(prepare(spark), folder))

    return {name: bind(f) for name, f in QUERIES.items()}


def days(trips: DataFrame, soc_used: str = "from_levels") -> DataFrame:
    return loads.trips_to_days(trips, ["veh_id", "date"], F.col("place"), soc_used=soc_used)


def charging_scope(t: Tables, **options) -> charging.Scope:
    return charging.Scope(t.refuel_inf, t.charger, t.fleet, **options)


# ---- Q1-Q10


@query
def q01_vehicle_day(t):
    return sequences.vehicle_day(t.veh_tel)


@query
def q01_vehicle_day_of_fleets(t):
    return telematics.vehicle_days(t.veh_tel, t.vehicle, [0, 3, 5, 8, 12, 19, 20, 23], idle_threshold_minutes=60.0)


@query
def q02_charging_kpis(t):
    return charging.kpis(charging_scope(t))


@query
def q03_charging_summary(t):
    return charging.summary(charging_scope(t))


@query
def q03_charging_summary_recent(t):
    return charging.summary(charging_scope(t, recent=True))


@query
def q03_charging_summary_filtered(t):
    return charging.summary(charging_scope(t, charger_type="DCFC", start="1996-01-01", end="2000-06-30"))


@query
def q04_daily_means(t):
    return charging.daily_means(charging_scope(t))


@query
def q05_hourly_starts_ends(t):
    return charging.hourly_starts_ends(charging_scope(t))


@query
def q06_weekday_hours(t):
    return charging.weekday_hours(charging_scope(t))


@query
def q06_weekday_hours_recent(t):
    return charging.weekday_hours(charging_scope(t, recent=True))


@query
def q07_fleet_usage(t):
    rows = usage.scoped(days(t.veh_trip), t.vehicle, t.fleet)
    return usage.fleet_summary(rows, t.vehicle, t.fleet)


@query
def q07_fleet_usage_recent(t):
    rows = usage.scoped(days(t.veh_trip), t.vehicle, t.fleet, recent=True)
    return usage.fleet_summary(rows, t.vehicle, t.fleet)


@query
def q08_usage_headline(t):
    return usage.headline(usage.measured(days(t.veh_trip)), t.vehicle, t.fleet)


@query
def q09_daily_metrics(t):
    return usage.daily_metrics(usage.measured(days(t.veh_trip)), list(usage.METRIC_AGGREGATES))


@query
def q10_daily_efficiency(t):
    return usage.daily_efficiency(usage.measured(days(t.veh_trip)))


# ---- Q11-Q14


@query
def q11_maintenance_kpis(t):
    return maintenance.kpis(t.maintenance)


@query
def q12_maintenance_table(t):
    rows = maintenance.scoped(t.maintenance, t.vehicle, t.charger, t.fleet)
    return maintenance.fleet_table(rows, t.vehicle, t.charger, t.fleet)


@query
def q13_category_share(t):
    return maintenance.composition(maintenance.measured(t.maintenance), "category")


@query
def q13_warranty_share(t):
    return maintenance.composition(maintenance.measured(t.maintenance), "warranty_covered")


@query
def q13_location_share(t):
    return maintenance.composition(maintenance.measured(t.maintenance), "location")


@query
def q14_charger_scope_recent(t):
    rows = maintenance.scoped(t.maintenance, t.vehicle, t.charger, t.fleet, asset_type="charger", recent=True)
    return maintenance.fleet_table(rows, t.vehicle, t.charger, t.fleet, "charger")


@query
def q14_fleet_scope(t):
    rows = maintenance.scoped(
        t.maintenance, t.vehicle, t.charger, t.fleet, fleets=["NATION_3", "NATION_7"], start="1997-01-01", end="1999-12-31"
    )
    return maintenance.composition(rows, "location")


# ---- Q15-Q20, Q27


@query
def q15_telematics_kpis(t):
    return telematics.kpis(t.veh_tel)


@query
def q16_telematics_summary(t):
    return telematics.summary(t.veh_tel, t.vehicle, t.fleet)


@query
def q16_telematics_summary_filtered(t):
    return telematics.summary(t.veh_tel, t.vehicle, t.fleet, fleet_name="NATION_2", start="2024-01-05", end="2024-01-20")


@query
def q17_tracks(t):
    return telematics.tracks(t.veh_tel, t.vehicle, t.fleet)


@query
def q17_track_pieces(t):
    pieces = telematics.tracks(t.veh_tel, t.vehicle, t.fleet, pieces=True)
    line = F.array_join(F.transform("positions", lambda x: F.format_string("%.4f %.4f", x["latitude"], x["longitude"])), ";")
    return pieces.select("veh_id", "fleet_name", "fleet_vehicle_id", "piece_no", line.alias("line"))


@query
def q18_fleet_overview(t):
    return fleet.overview(t.fleet, t.charger)


@query
def q19_vehicle_models(t):
    return fleet.vehicle_models(t.vehicle)


@query
def q19_charger_kinds(t):
    return fleet.charger_kinds(t.charger)


@query
def q20_charging_options(t):
    return charging.options(charging_scope(t))


@query
def q20_usage_options(t):
    return usage.options(days(t.veh_trip), t.vehicle, t.fleet)


@query
def q20_vehicle_options(t):
    return telematics.vehicle_options(t.vehicle, t.fleet)


@query
def q20_asset_options(t):
    return maintenance.asset_options(t.maintenance, t.vehicle, t.charger, t.fleet)


@query
def q27_recent_samples(t):
    return telematics.recent_samples(t.veh_tel, t.vehicle, t.fleet)


# ---- Q21-Q26


@query
def q21_trip_days(t):
    return days(t.veh_trip)


@query
def q21_trip_days_reported(t):
    return days(t.veh_trip, "reported")


@query
def q21_trip_report(t):
    return loads.trip_report(sheets.trip_report(t), sheets.serial_codes(t), t.vehicle).drop("vin", "fleet_vehicle_id")


@query
def q21_daily_trips_sheet(t):
    return loads.daily_trips_sheet(sheets.daily_trips(t), t.vehicle)


def _without_point(df: DataFrame) -> DataFrame:
    return df.drop("location")


@query
def q22_report_samples(t):
    out = loads.load_report(sheets.report_sheet(t), sheets.serial_codes(t), t.vehicle)
    return out.select("veh_id", "timestamp", "speed", "mileage", "soc", "latitude", "longitude", "details")


@query
def q22_fleet_file(t):
    return _without_point(loads.load_fleet_file(sheets.fleet_file(t), t.vehicle, t.veh_tel)).withColumn(
        "mileage", round_to(F.col("mileage"), 4)
    )


@query
def q22_telematics_sheet(t):
    return _without_point(loads.load_sheet(sheets.telematics_sheet(t), t.vehicle))


@query
def q22_vehicle_files(t):
    return _without_point(loads.load_vehicle_files(sheets.vehicle_files(t), t.vehicle))


@query
def q23_utc_sessions(t):
    return loads.load_utc_sessions(sheets.utc_sessions(t), t.charger, t.vehicle)


@query
def q23_local_sessions(t):
    return loads.load_local_sessions(sheets.local_sessions(t), t.charger, t.vehicle)


@query
def q23_session_list(t):
    return loads.load_session_list(sheets.session_list(t), t.charger, t.vehicle)


def _vehicle_codes(t: Tables) -> DataFrame:
    return t.vehicle.select("id", F.col("fleet_vehicle_id").alias("code"))


def _charger_codes(t: Tables) -> DataFrame:
    return t.charger.select("id", F.col("charger").alias("code"))


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("parts_cost", "labor_cost", "add_cost")})


@query
def q24_maintenance_sheet(t):
    return _money_as_double(loads.maintenance_sheet(sheets.maintenance_sheet(t), t.vehicle))


@query
def q24_maintenance_workbooks(t):
    return _money_as_double(
        loads.maintenance_workbooks(
            loads.maintenance_workbook(sheets.maintenance_workbook(t, "vehicle"), _vehicle_codes(t), "vehicle"),
            loads.maintenance_workbook(sheets.maintenance_workbook(t, "charger"), _charger_codes(t), "charger"),
        )
    )


@query
def q25_daily_summary(t):
    return loads.daily_summary(sheets.daily_summary(t), t.vehicle)


@query
def q26_payload(t):
    return loads.payload(sheets.payload_sheets(t), t.vehicle)


# ---- single operators


def _hourly_samples(t: Tables) -> DataFrame:
    """Samples cut to the hour: many rows share a key."""
    hour = F.col("timestamp") - F.expr("make_dt_interval(0, 0, minute(timestamp), extract(second from timestamp))")
    return t.veh_tel.withColumn("timestamp", hour)


@query
def c04_local_to_utc(t):
    wall = t.refuel_inf.select("id", F.col("connect_time").alias("wall"))
    wall = local_to_utc(wall, {"wall": "shifted"})
    wall = local_to_utc(wall, {"wall": "strict"}, gap="null")
    wall = local_to_utc(wall, {"wall": "first_pass"}, fold=F.lit(0))
    return local_to_utc(wall, {"wall": "second_pass"}, fold=F.lit(1)).drop("wall")


@query
def c16_cost_texts(t):
    text = F.expr(
        "case when id % 4 = 0 then concat('$', format_number(round(cast(labor_cost as decimal(28,8)), 2), 2), ' (tow + ', id, ')') "
        "when id % 4 = 1 then concat(' ', maint_categ, ' ') when id % 4 = 2 then concat('-', id, ' credit') else '  ' end"
    )
    return t.maintenance.select("id", text.alias("x")).select(
        "id", p.first_number(F.col("x")).alias("amount"), p.cost_note(F.col("x")).alias("note")
    )


@query
def a16_date_bounds(t):
    return filters.date_bounds(t.maintenance)


@query
def f06_latest_month(t):
    return filters.latest_month_bounds(t.veh_tel)


@query
def w04_service_intervals(t):
    return sequences.service_interval(t.maintenance).withColumn("avg_miles", round_to(F.col("avg_miles"), 4))


@query
def w05_monotonic_mileage(t):
    out = sequences.monotonic_mileage(t.veh_tel, raw="mileage", out="rebuilt")
    return out.select("id", "veh_id", round_to(F.col("rebuilt"), 4).alias("rebuilt"))


@query
def w06_anchored_mileage(t):
    batch = t.veh_tel.where("timestamp >= '2024-01-11'")
    stored = t.veh_tel.where("timestamp < '2024-01-15'")
    anchors = joins.asof_anchor(batch, stored).select("veh_id", "anchor")
    out = sequences.monotonic_mileage(batch, raw="mileage", out="rebuilt", anchors=anchors)
    return out.select("id", "veh_id", round_to(F.col("rebuilt"), 4).alias("rebuilt"))


@query
def w07_gps_jumps(t):
    return ordered_fold.flag_gps_jumps(t.veh_tel.select("id", "veh_id", "timestamp", "latitude", "longitude")).select(
        "id", "veh_id", "gps_outlier"
    )


@query
def w08_doubled_readings(t):
    rows = t.veh_tel.withColumn("row_no", F.col("id")).select("row_no", "veh_id", "timestamp", "mileage", "soc")
    return ordered_fold.repair_doubled(rows).select(
        F.col("row_no").alias("id"), "veh_id", "kept", "mileage_fixed", "soc_fixed",
        F.when(F.col("kept"), F.col("mileage")).alias("mileage"), F.when(F.col("kept"), F.col("soc")).alias("soc"),
    )


@query
def w09_keep_last(t):
    return sequences.keep_last(_hourly_samples(t), ["veh_id", "timestamp"], F.col("id").desc()).select(
        "veh_id", "timestamp", "id", "speed"
    )


@query
def w10_keep_best(t):
    rows = _hourly_samples(t).withColumn("details", F.expr("case details when 'signup' then 'Ignition On' else details end"))
    return sequences.keep_best_sample(rows, ["veh_id", "timestamp"], F.col("id").desc()).select(
        "veh_id", "timestamp", "id", "speed", "details"
    )


@query
def w12_series_slots(t):
    return sequences.dense_slot(t.fleet, "fleet_name", 24)


@query
def b06_vehicle_keys(t):
    trips = t.veh_trip.groupBy("veh_id").agg(F.count("*").alias("n")).selectExpr(
        "case when veh_id % 2 = 0 then concat('Customer#', lpad(cast(veh_id as string), 9, '0')) else concat('X', veh_id) end as code",
        "n",
    )
    return resolve_key(trips, t.vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id")


@query
def j08_asof_anchor(t):
    return joins.asof_anchor(t.veh_tel.where("timestamp >= '2024-01-11'"), t.veh_tel)


def _stored_days(t: Tables) -> DataFrame:
    return days(t.veh_trip.where("report <> 'R'")).withColumn("peak_payload", F.lit(None).cast("int"))


def _incoming_days(t: Tables) -> DataFrame:
    return days(t.veh_trip.where("report <> 'A'"))


_DAY = ["veh_id", "date"]


@query
def j1_insert_absent(t):
    return merge.merge_into(_stored_days(t), _incoming_days(t), _DAY, policy="insert_absent")


@query
def j2_overwrite(t):
    return merge.merge_into(_stored_days(t), _incoming_days(t), _DAY, policy="overwrite", columns=DAILY_VALUES).drop("merge_action")


@query
def j3_changed_counts(t):
    merged = merge.merge_into(_stored_days(t), _incoming_days(t), _DAY, policy="overwrite", columns=DAILY_VALUES)
    return merged.groupBy("merge_action").agg(F.count("*").alias("n"))


@query
def j4_payload_only(t):
    load = loads.payload(sheets.payload_sheets(t), t.vehicle)
    return merge.merge_into(_stored_days(t), load, _DAY, policy="overwrite", columns=["peak_payload"])


@query
def j5_fill_nulls(t):
    return merge.merge_into(_stored_days(t), _incoming_days(t), _DAY, policy="fill_nulls")


@query
def j6_insert_unmatched(t):
    stored = t.maintenance.where("warranty is not null")
    return joins.not_stored(t.maintenance, stored, ["veh_id", "enter_shop"]).select("id", "veh_id", "enter_shop")


_EVENT = ["date", "maint_ob", "maint_categ", "maint_loc", "enter_odo", "warranty", "veh_id", "charger_id"]


@query
def j7_insert_distinct(t):
    return merge.insert_distinct(t.maintenance.where("maint_loc is not null"), t.maintenance, _EVENT)


@query
def j8_unique_source(t):
    day = F.when(F.col("id") % 97 != 0, F.col("date")).alias("date")
    trips = t.veh_trip.select("veh_id", day, "id", "tot_dist", "place")
    return merge.unique_source(trips, ["veh_id", "date"], F.col("place")).drop("place")


@query
def j9_without_fleet(t):
    kept = merge.without_fleet_sessions(t.refuel_inf, t.charger, t.fleet, "NATION_3")
    return kept.groupBy("charger_id").agg(F.count("*").alias("n"))


@query
def k3_overlap_counts(t):
    stored = t.veh_tel.where("details <> 'signup'")
    incoming = t.veh_tel.where("details <> 'error'").withColumn("speed", F.expr("case when details = 'view' then speed + 0.5 else speed + 1e-9 end"))
    digits = {"speed": 6, "mileage": 6, "latitude": 8, "longitude": 8}
    return merge.overlap_counts(incoming, stored, ["veh_id", "timestamp"], digits)


# ---- data health


@query
def dq1_unmapped_chargers(t):
    return health.unmapped_codes(t.refuel_inf, "charger_id", t.charger, "id")


@query
def dq2_orphans(t):
    return health.orphan_counts(
        {
            "veh_tel": (t.veh_tel, "veh_id", t.vehicle),
            "veh_trip": (t.veh_trip, "veh_id", t.vehicle),
            "refuel_inf.veh": (t.refuel_inf, "veh_id", t.vehicle),
            "refuel_inf.charger": (t.refuel_inf, "charger_id", t.charger),
            "maintenance": (t.maintenance, "veh_id", t.vehicle),
        }
    )


def _per_fleet(t: Tables, fleets=None) -> DataFrame:
    return health.per_fleet(t.veh_tel, t.refuel_inf, days(t.veh_trip), t.maintenance, t.vehicle, t.charger, t.fleet, fleets)


@query
def dq3_latest_per_fleet(t):
    return _per_fleet(t).drop("n_points")


@query
def dq4_rows_per_fleet(t):
    return _per_fleet(t).drop("latest_date")


@query
def dq4_rows_of_fleets(t):
    return _per_fleet(t, ["NATION_1", "NATION_9", "Unspecified"]).drop("latest_date")


@query
def dq5_load_status(t):
    return usage.status(days(t.veh_trip))


@query
def dq6_rejections(t):
    samples = loads.report_samples(sheets.report_sheet(t), sheets.serial_codes(t))
    return health.rejections(samples, filters.sample_rules("fleet_vehicle_id"))


@query
def dq6_fleet_file(t):
    samples = loads.fleet_file_samples(sheets.fleet_file(t), t.vehicle)
    rules = {k: v for k, v in filters.sample_rules().items() if k in ("missing_timestamp", "unmapped_vehicle")}
    lost = health.duplicates(filters.passing(samples, rules), ["veh_id", "timestamp"])
    return health.rejections(samples, rules).select("*", lost.scalar().alias("duplicates_removed"))


@query
def dq6_repairs(t):
    rows = t.veh_tel.withColumn("row_no", F.col("id"))
    return health.repairs(ordered_fold.repair_doubled(rows))


@query
def dq7_duplicate_codes(t):
    return health.duplicate_codes(t.vehicle.select("fleet_id", "make", "model"), ["fleet_id", "make", "model"])


@query
def k5_trips(t):
    """The vehicle-days of a stream that arrives in three parts, some samples half an hour late, over three restarts."""
    tel = t.veh_tel.where("veh_id is not null and timestamp is not null")
    spark = tel.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/k5-{uuid.uuid4().hex}"
    samples = tel.select("id", "veh_id", "timestamp", "mileage", "soc", "speed")
    low, high = samples.agg(F.min("timestamp"), F.max("timestamp")).first()
    low, high = low or datetime(2000, 1, 1), high or datetime(2000, 1, 1)
    borders = [low, low + (high - low) / 3, low + (high - low) * 2 / 3, high + timedelta(days=1)]
    arrival = F.col("timestamp") + F.when(F.col("id") % 3 == 0, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
    for number, (start, end) in enumerate(zip(borders, borders[1:])):
        part = samples.where((arrival < F.lit(end)) & ((arrival >= F.lit(start)) if number else F.lit(True)))
        vehicle_days.drained(part.drop("id"), f"{folder}/in", f"{folder}/out", f"{folder}/marks")
    # A sample of no vehicle, days later, ends every day.
    close = spark.createDataFrame([(-1, high + timedelta(days=3))], "veh_id long, timestamp timestamp_ntz")
    last = close.select(*[F.col(c).cast(k) if c in close.columns else F.lit(None).cast(k).alias(c) for c, k in part.drop("id").dtypes])
    vehicle_days.drained(last, f"{folder}/in", f"{folder}/out", f"{folder}/marks")
    nothing = {"tot_energy": F.lit(None).cast("double"), "peak_payload": F.lit(None).cast("int")}
    return spark.read.parquet(f"{folder}/out").withColumns(nothing)


@query
def b06_codes_of_two_fleets(t):
    """Codes that several fleets use, resolved inside the fleet that reports them."""
    code = lambda c: F.concat(F.lit("V"), (F.col(c) % 50).cast("string"))
    coded = t.vehicle.groupBy("fleet_id", code("id").alias("unit")).agg(F.min("id").alias("id"))
    seen = t.veh_trip.where("veh_id is not null").groupBy((F.col("veh_id") % 26).alias("fleet_id"), code("veh_id").alias("unit")).agg(F.count("*").alias("n"))
    return resolve_key(seen, coded, {"fleet_id": "fleet_id", "unit": "unit"}, "id", "veh_id")


@query
def b10_fill_dimension(t):
    """Members that are missing are added, empty makes are filled, known models stay."""
    known = t.vehicle.where("id % 3 <> 0").select("fleet_id", "fleet_vehicle_id", F.when(F.col("id") % 5 != 0, F.col("make")).alias("make"), "model")
    seeds = t.vehicle.select("fleet_id", "fleet_vehicle_id", F.concat(F.lit("seed "), F.coalesce("make", F.lit("-"))).alias("make"), F.concat(F.lit("seed "), F.col("model")).alias("model"))
    return fill_dimension(known, seeds, ["fleet_id", "fleet_vehicle_id"])


@query
def b11_rekey(t):
    """Trip counts that still name vehicles by their code get keys; a code without a vehicle would fail the query."""
    counts = t.veh_trip.join(t.vehicle.select(F.col("id").alias("veh_id"), "fleet_vehicle_id"), "veh_id").groupBy("fleet_vehicle_id").agg(F.count("*").alias("n"))
    return rekey(counts.withColumnRenamed("fleet_vehicle_id", "veh_id"), t.vehicle, "veh_id", "fleet_vehicle_id")


@query
def c30_points(t):
    position = geo.point(F.col("latitude"), F.col("longitude"))
    return t.veh_tel.select("id", position["lon"].alias("lon"), position["lat"].alias("lat"), position.isNull().alias("nowhere"))


_SESSION = ["charger_id", "refuel_start"]


@query
def q23_sessions_merged(t):
    """Loaded sessions on their unique key (charger and start) over stored ones: incoming values win, rows count by action."""
    values = ["refuel_end", "tot_energy", "start_soc", "end_soc", "veh_id"]
    loaded = loads.load_utc_sessions(sheets.utc_sessions(t), t.charger, t.vehicle).select(*_SESSION, *values)
    unique = merge.unique_source(loaded, _SESSION, *[F.col(c).asc_nulls_first() for c in values])
    stored = t.refuel_inf.where("id % 3 <> 0").select(*_SESSION, *values)
    return merge.merge_into(stored, unique, _SESSION, policy="overwrite")


@query
def q22_samples_merged(t):
    """Cleaned samples on (vehicle, time) over stored ones: stored values stay, empty ones are filled, new samples are added."""
    columns = ["veh_id", "timestamp", "speed", "mileage", "soc"]
    loaded = loads.load_report(sheets.report_sheet(t), sheets.serial_codes(t), t.vehicle).select(*columns)
    older = F.hour("timestamp") % 2 == 0
    stored = loaded.where(older).withColumns({"speed": F.col("speed") + 1, "soc": F.when(F.hour("timestamp") % 4 == 0, F.col("soc"))})
    others = t.veh_tel.where("id % 50 = 0").select("veh_id", (F.col("timestamp") + F.expr("interval 400 day")).alias("timestamp"), *columns[2:])
    return merge.merge_into(stored.unionByName(others), loaded, ["veh_id", "timestamp"], policy="fill_nulls")


@query
def c05_repeated_hours(t):
    """Samples told again as clock times of an autumn change day, whose second hour occurs twice."""
    clock = F.lit(datetime(2024, 11, 3)).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 240).cast("int"))
    return localize_in_row_order(t.veh_tel.select("id", "veh_id", clock.alias("local")), "local", "utc", ["veh_id"], ["id"]).select("id", "veh_id", "utc")
