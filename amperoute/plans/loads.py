"""Vendor loads: sheets of text in, typed fact rows out (Q21-Q26).

A sheet is a DataFrame of text columns with the vendor's headers plus ``row_no``, the row's place in the
file. The four shapes differ in headers, clocks, SOC units and duplicate rules, not in the engine's steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse as p
from ..functions.geo import point
from ..functions.measures import average_power, floor_at_zero, half_even_int, minutes_between, minutes_to_hours, round_to
from ..functions.staging import evaluated
from ..functions.zones import local_to_utc, localize_in_row_order
from ..operators.conform import normalize_headers, require, resolve, resolve_key
from ..operators.filters import (
    data_rows, null_bad_position, passing, positive_payload, sample_rules, valid_sessions, with_position,
)
from ..operators.joins import asof_anchor
from ..operators.ordered_fold import null_gps_jumps, repair_doubled
from ..operators.sequences import keep_best_sample, keep_last, monotonic_mileage
from ..session import written

TEL_KEY = ["veh_id", "timestamp"]


def _landed(df: DataFrame) -> DataFrame:
    """Parsed rows as checkpointed files: the ordered steps after it read them several times, each only its columns."""
    return written(df)


def _located(df: DataFrame) -> DataFrame:
    return df.withColumn("location", point(F.col("latitude"), F.col("longitude")))


# ---- telematics (Q22)


def report_samples(sheet: DataFrame, codes: DataFrame) -> DataFrame:
    """Report with a serial per row; ``codes`` maps vin to fleet_vehicle_id (B5). Unclean rows stay."""
    header = ["Vehicle ID", "Date/Time", "Latitude", "Longitude", "Speed (mph)", "State of Charge", "Odometer", "Details"]
    raw = require(normalize_headers(sheet), header, "telematics report")
    rows = raw.select(
        F.trim("Vehicle ID").alias("vin"),
        p.datetime(F.col("Date/Time")).alias("timestamp"),
        p.number(F.col("`Speed (mph)`")).alias("speed"),
        p.number(F.col("Odometer")).alias("mileage"),
        p.soc_share(p.number(F.col("State of Charge"))).alias("soc"),
        p.number(F.col("Latitude")).alias("latitude"),
        p.number(F.col("Longitude")).alias("longitude"),
        F.col("Details").alias("details"),
        "row_no",
    )
    rows = local_to_utc(rows, ["timestamp"])
    return resolve_key(rows, codes, {"vin": "vin"}, "fleet_vehicle_id", "fleet_vehicle_id")


def clean_report(samples: DataFrame) -> DataFrame:
    """Range rules, positions nulled, best sample per vehicle and instant."""
    good = null_bad_position(passing(samples, sample_rules("fleet_vehicle_id")))
    return keep_best_sample(good, ["fleet_vehicle_id", "timestamp"], F.col("row_no").desc())


def load_report(sheet: DataFrame, codes: DataFrame, vehicle: DataFrame, *, unmapped: str = "fail") -> DataFrame:
    cleaned = clean_report(report_samples(sheet, codes))
    return _located(
        resolve_key(cleaned, vehicle, {"fleet_vehicle_id": "fleet_vehicle_id"}, "id", "veh_id", unmapped=unmapped)
    )


def fleet_file_samples(sheet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """One file per fleet, clock in two columns, mileage a counter that resets."""
    wanted = {
        "date_text": {"exact": ["Date"]},
        "time_text": {"prefix": "time("},
        "asset": {"exact": ["Asset No."]},
        "speed": {"exact": ["Speed(MPH)"]},
        "mileage_raw": {"exact": ["Distance Traveled(Miles)"]},
        "latitude": {"exact": ["Lat"]},
        "longitude": {"exact": ["Lon"]},
        "row_no": {"exact": ["row_no"]},
    }
    raw = resolve(sheet, wanted, "fleet telematics")
    rows = evaluated(raw.withColumn("local", p.datetime_of_parts(F.col("date_text"), F.col("time_text"))))
    rows = localize_in_row_order(rows, "local", "timestamp", ["asset"], ["row_no"]).select(
        "asset", "timestamp", *[p.number(F.col(c)).alias(c) for c in ("speed", "mileage_raw", "latitude", "longitude")], "row_no"
    )
    return resolve_key(rows, vehicle, {"asset": "fleet_vehicle_id"}, "id", "veh_id").drop("asset")


def load_fleet_file(sheet: DataFrame, vehicle: DataFrame, stored: DataFrame) -> DataFrame:
    """Starts jobs. Drop unmapped rows, last row per key, GPS jumps nulled, mileage rebuilt from the stored anchor."""
    mapped = fleet_file_samples(sheet, vehicle).where("veh_id is not null and timestamp is not null")
    unique = _landed(keep_last(mapped, TEL_KEY, F.col("row_no").desc()))
    anchors = asof_anchor(unique, stored).select("veh_id", "anchor")
    rebuilt = monotonic_mileage(null_gps_jumps(unique), anchors=anchors)
    return _located(rebuilt.drop("gps_outlier", "mileage_raw", "row_no"))


def sheet_samples(sheet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Workbook with SOC in percent and readings that sometimes double."""
    header = ["Data Timestamp", "Vehicle ID", "Speed", "Odometer", "Latitude", "Longitude", "Elevation",
              "State Of Charge", "Total Travel Time (Hrs)"]
    raw = require(sheet, header, "telematics sheet").withColumn("local", p.datetime(F.col("Data Timestamp")))
    rows = localize_in_row_order(evaluated(raw), "local", "timestamp", ["Vehicle ID"], ["row_no"]).select(
        F.col("Vehicle ID").alias("code"),
        "timestamp",
        p.number(F.col("Elevation")).alias("elevation"),
        p.number(F.col("Speed")).alias("speed"),
        p.number(F.col("Odometer")).alias("mileage"),
        p.soc_from_percent(p.number(F.col("State Of Charge"))).alias("soc"),
        p.number(F.col("`Total Travel Time (Hrs)`")).alias("key_on_time"),
        p.number(F.col("Latitude")).alias("latitude"),
        p.number(F.col("Longitude")).alias("longitude"),
        "row_no",
    )
    return resolve_key(rows, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id").drop("code")


def load_sheet(sheet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Starts jobs. Doubled readings repaired, rows without a valid position or with bad ranges dropped, last row per key."""
    repaired = repair_doubled(_landed(sheet_samples(sheet, vehicle))).where("kept")
    rules = {k: v for k, v in sample_rules().items() if k in ("bad_speed", "bad_soc")}
    good = passing(with_position(repaired), rules)
    return _located(
        keep_last(good, TEL_KEY, F.col("row_no").desc()).drop("kept", "mileage_fixed", "soc_fixed", "row_no")
    )


def load_vehicle_files(sheet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """One file per vehicle (its name is the code), zoned clock, SOC clamped (C7, C13d). First row per key."""
    header = ["name", "timeStamp", "latitude", "longitude", "speed", "odometer", "stateOfCharge", "keyOnTime"]
    raw = require(sheet, header, "vehicle telematics")
    rows = raw.select(
        F.col("code"),
        p.utc_datetime(F.col("timeStamp")).alias("timestamp"),
        F.lit(None).cast("double").alias("elevation"),
        p.number(F.col("speed")).alias("speed"),
        p.number(F.col("odometer")).alias("mileage"),
        p.soc_share_clamped(p.number(F.col("stateOfCharge"))).alias("soc"),
        p.number(F.col("keyOnTime")).alias("key_on_time"),
        p.number(F.col("latitude")).alias("latitude"),
        p.number(F.col("longitude")).alias("longitude"),
        "row_no",
    )
    rows = evaluated(rows).where("timestamp is not null")
    mapped = resolve_key(rows, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id", unmapped="drop").drop("code")
    return _located(keep_last(mapped, TEL_KEY, F.col("row_no").asc()).drop("row_no"))


# ---- charging (Q23)


def _power(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_power", average_power(F.col("tot_energy"), F.col("tot_ref_dura")))


def load_utc_sessions(sheet: DataFrame, charger: DataFrame, vehicle: DataFrame) -> DataFrame:
    """UTC clock, duration as text, SOC as percent text. Unknown chargers drop, unknown vehicles stay null."""
    rows = sheet.select(
        p.charger_code(F.col("Serial Number"), F.col("Connector Number")).alias("plug"),
        p.vehicle_code(F.col("Tractor ID"), F.col("Tractor Number")).alias("code"),
        p.utc_datetime(F.col("Session Start Time")).alias("refuel_start"),
        p.utc_datetime(F.col("Session Stop Time")).alias("refuel_end"),
        p.number(F.col("`Energy Delivered (kWh)`")).alias("tot_energy"),
        p.duration_minutes(F.col("Duration")).alias("tot_ref_dura"),
        p.soc_from_percent_text(F.col("Battery State Of Charge At Session Start")).alias("start_soc"),
        p.soc_from_percent_text(F.col("Battery State Of Charge At Session Stop")).alias("end_soc"),
    )
    good = _power(valid_sessions(evaluated(rows), "refuel_start", "refuel_end"))
    known = resolve_key(good, charger, {"plug": "charger"}, "id", "charger_id", unmapped="drop")
    upper = vehicle.select("id", F.upper("fleet_vehicle_id").alias("fleet_vehicle_id"))
    return resolve_key(known, upper, {"code": "fleet_vehicle_id"}, "id", "veh_id").drop("plug", "code")


def load_local_sessions(sheet: DataFrame, charger: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Local clock (skipped and repeated times are unusable), duration from start and end."""
    rows = sheet.select(
        p.charger_code_before_colon(F.col("Charger ID"), F.col("Port")).alias("plug"),
        F.col("Vehicle ID").alias("code"),
        p.datetime(F.col("Connect Time")).alias("connect_time"),
        p.datetime(F.col("Disconnect Time")).alias("disconnect_time"),
        p.datetime(F.col("Charge Start Time")).alias("refuel_start"),
        p.datetime(F.col("Charge End Time")).alias("refuel_end"),
        p.number(F.col("Peak Power")).alias("max_power"),
        p.number(F.col("Energy Dispensed")).alias("tot_energy"),
        p.soc_from_percent_text(F.col("Vehicle SoC at start of Charging")).alias("start_soc"),
        p.soc_from_percent_text(F.col("Vehicle SoC at end of Charging")).alias("end_soc"),
    )
    rows = local_to_utc(rows, ["connect_time", "disconnect_time", "refuel_start", "refuel_end"], gap="null")
    rows = evaluated(rows.withColumn("tot_ref_dura", round_to(minutes_between(F.col("refuel_start"), F.col("refuel_end")), 2)))
    good = _power(valid_sessions(rows, "connect_time", "disconnect_time"))
    known = resolve_key(good, charger, {"plug": "charger"}, "id", "charger_id", unmapped="drop")
    return resolve_key(known, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id").drop("plug", "code")


def load_session_list(sheet: DataFrame, charger: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Session list of one fleet: connector names its charger, the vehicle leads a hash; both must be known."""
    rows = normalize_headers(sheet).select(
        F.trim("Connector").alias("plug"),
        p.leading_code(F.col("Vehicle ID")).alias("code"),
        p.datetime(F.col("`Session start (America/New_York)`")).alias("connect_time"),
        p.datetime(F.col("`Session end (America/New_York)`")).alias("disconnect_time"),
        round_to(p.duration_minutes(F.col("`Charging duration (hh:mm:ss)`")), 2).alias("tot_ref_dura"),
        p.number(F.col("`Charged Energy (kWh)`")).alias("tot_energy"),
        p.number(F.col("`Peak power (kW)`")).alias("max_power"),
        p.soc_share_clamped(p.number(F.col("`Battery level at start (%)`"))).alias("start_soc"),
        p.soc_share_clamped(p.number(F.col("`Battery level at end (%)`"))).alias("end_soc"),
    )
    rows = local_to_utc(rows, ["connect_time", "disconnect_time"], gap="null")
    good = _power(valid_sessions(rows, "connect_time", "disconnect_time"))
    known = resolve_key(good, charger, {"plug": "charger"}, "id", "charger_id", unmapped="drop")
    return resolve_key(known, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id", unmapped="drop").drop("plug", "code")


# ---- maintenance (Q24)


def maintenance_sheet(sheet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Plain sheet of one fleet's vehicle events; unknown vehicles stay null."""
    rows = sheet.select(
        F.col("Vehicle ID").alias("code"),
        F.col("Category").alias("maint_categ"),
        F.col("Location").alias("maint_loc"),
        p.datetime(F.col("Date to Shop")).alias("enter_shop"),
        p.datetime(F.col("Date Returned")).alias("exit_shop"),
        p.number(F.col("Start Odometer")).cast("int").alias("enter_odo"),
        p.number(F.col("Returned Odometer")).cast("int").alias("exit_odo"),
        *[p.number(F.col(c)).cast("decimal(12,2)").alias(n) for c, n in
          (("Parts Costs", "parts_cost"), ("Labor Costs", "labor_cost"), ("Added Costs", "add_cost"))],
        F.col("Added Costs Desc").alias("add_cost_desc"),
        p.boolean(F.col("Warranty Coverage?")).alias("warranty"),
        F.col("Desc of Problem").alias("problem"),
        F.col("Desc of Work Done").alias("work_perf"),
    )
    mapped = resolve_key(rows, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id").drop("code")
    return mapped.withColumn("date", F.to_date("enter_shop")).withColumn(
        "maint_ob", F.when(F.col("veh_id").isNotNull(), F.lit(1))
    )


# What identifies each long workbook header.
WORKBOOK_HEADERS = {
    "asset_code": {"parts": ["vehicle id", "unique"]},
    "categ": {"parts": ["maintenance category"]},
    "problem_text": {"parts": ["description of the condition or problem"]},
    "work": {"parts": ["description of the work performed"]},
    "maint_loc": {"parts": ["in-house or outsourced"]},
    "enter": {"parts": ["entered the shop"]},
    "exit": {"parts": ["exited the shop"]},
    "enter_odo_text": {"parts": ["odometer reading upon entering"]},
    "exit_odo_text": {"parts": ["odometer reading upon exiting"]},
    "parts": {"parts": ["parts cost"]},
    "labor": {"parts": ["labor cost"]},
    "extra": {"parts": ["additional costs"]},
    "covered": {"parts": ["warranty covered"]},
}


def maintenance_workbook(sheet: DataFrame, dim: DataFrame, asset_type: str) -> DataFrame:
    """Workbook with long headers (B3) and free text; ``dim`` is vehicles or chargers of the fleet (id, code)."""
    raw = resolve(data_rows(normalize_headers(sheet)), WORKBOOK_HEADERS, "maintenance workbook")
    problem = p.problem_with_detail(F.col("categ"), F.col("problem_text"))
    if asset_type == "charger":
        problem = p.with_station_note(F.trim("asset_code"), problem)
    rows = raw.select(
        F.trim("asset_code").alias("asset_code"),
        p.category(F.col("categ")).alias("maint_categ"),
        F.trim("maint_loc").alias("maint_loc"),
        p.datetime(F.col("enter")).alias("enter_shop"),
        p.datetime(F.col("exit")).alias("exit_shop"),
        half_even_int(p.number(F.col("enter_odo_text"))).alias("enter_odo"),
        half_even_int(p.number(F.col("exit_odo_text"))).alias("exit_odo"),
        p.first_number(F.col("parts")).cast("decimal(12,2)").alias("parts_cost"),
        p.first_number(F.col("labor")).cast("decimal(12,2)").alias("labor_cost"),
        p.first_number(F.col("extra")).cast("decimal(12,2)").alias("add_cost"),
        p.cost_note(F.col("extra")).alias("add_cost_desc"),
        p.boolean(F.col("covered")).alias("warranty"),
        problem.alias("problem"),
        p.blank_to_null(F.col("work")).alias("work_perf"),
    ).withColumn("date", F.to_date("enter_shop"))
    out = "veh_id" if asset_type == "vehicle" else "charger_id"
    mapped = resolve_key(rows, dim, {"asset_code": "code"}, "id", out)
    station = F.col("asset_code") == p.STATION_CODE
    known = F.col(out).isNotNull() if asset_type == "vehicle" else F.col(out).isNotNull() | station
    return mapped.where(known).withColumn("maint_ob", F.lit(1 if asset_type == "vehicle" else 2)).drop("asset_code")


def maintenance_workbooks(vehicle_events: DataFrame, charger_events: DataFrame) -> DataFrame:
    """Both asset types in one frame, missing columns null."""
    return vehicle_events.unionByName(charger_events, allowMissingColumns=True)


# ---- daily usage (Q21, Q25, Q26)


def trips_to_days(trips: DataFrame, keys: list[str], order: Column, *, soc_used: str = "from_levels") -> DataFrame:
    """Trip rows to one row per vehicle and date; ``order`` ranks the trips of a day.

    SOC use is the sum of each trip's non-negative fall (``from_levels``) or of the reported values.
    """
    used = floor_at_zero(F.col("init_soc") - F.col("final_soc")) if soc_used == "from_levels" else F.col("soc_used")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), order))

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), order))

    def summed(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return trips.na.drop(subset=keys).groupBy(*keys).agg(
        F.max("trip_num").alias("trip_num"),
        first("init_odo").alias("init_odo"),
        last("final_odo").alias("final_odo"),
        round_to(summed(F.col("tot_dist")), 3).alias("tot_dist"),
        round_to(summed(F.col("tot_dura")), 3).alias("tot_dura"),
        round_to(summed(F.col("idle_time")), 3).alias("idle_time"),
        round_to(first("init_soc"), 4).alias("init_soc"),
        round_to(last("final_soc"), 4).alias("final_soc"),
        round_to(summed(used), 4).alias("tot_soc_used"),
        round_to(summed(F.col("tot_energy")), 3).alias("tot_energy"),
    )


def trip_report(sheet: DataFrame, codes: DataFrame, vehicle: DataFrame, *, unmapped: str = "fail") -> DataFrame:
    """Trip report by serial: durations as clock text, SOC used from levels."""
    header = ["Vehicle ID", "Trip", "Date", "Begin Odometer", "End Odometer", "Idling Duration", "Driving Duration",
              "Distance", "Beginning State Of Charge", "Ending State Of Charge", "Total kWh used"]
    raw = require(normalize_headers(sheet), header, "trip report")
    trips = raw.select(
        p.blank_to_null(F.col("Vehicle ID")).alias("vin"),
        p.day(F.col("Date")).alias("date"),
        p.number(F.col("Trip")).cast("int").alias("trip_num"),
        p.number(F.col("Begin Odometer")).alias("init_odo"),
        p.number(F.col("End Odometer")).alias("final_odo"),
        p.duration_hours(F.col("Idling Duration")).alias("idle_time"),
        p.duration_hours(F.col("Driving Duration")).alias("tot_dura"),
        p.number(F.col("Distance")).alias("tot_dist"),
        p.number(F.col("Beginning State Of Charge")).alias("init_soc"),
        p.number(F.col("Ending State Of Charge")).alias("final_soc"),
        p.number(F.col("Total kWh used")).alias("tot_energy"),
        "row_no",
    )
    days = trips_to_days(evaluated(trips), ["vin", "date"], trip_order())
    coded = resolve_key(days, codes, {"vin": "vin"}, "fleet_vehicle_id", "fleet_vehicle_id", unmapped=unmapped)
    return resolve_key(coded, vehicle, {"fleet_vehicle_id": "fleet_vehicle_id"}, "id", "veh_id", unmapped=unmapped)


def trip_order() -> Column:
    """Trip number (missing last), then place in the file, as one exact number of fixed width, which hash aggregates keep in place."""
    digits = "decimal(38,0)"
    number = F.coalesce(F.col("trip_num").cast("long").cast(digits), F.lit(str(2**63)).cast(digits))
    return (number * F.lit(str(2**63)).cast("decimal(20,0)") + F.col("row_no").cast("long").cast(digits)).cast(digits)


# Headers of the daily trips sheet.
DAILY_TRIPS = {
    "code": {"exact": ["Vehicle ID"]},
    "day": {"exact": ["Date"]},
    "trip": {"exact": ["Trip Nbr"]},
    "start_odo": {"exact": ["Start Odometer"]},
    "end_odo": {"exact": ["End Odometer"]},
    "dist": {"exact": ["Distance Traveled"]},
    "travel": {"exact": ["Total Travel Time", "Total Travel Time (Hrs)"]},
    "idle": {"exact": ["Total Idle Time", "Total Idle Time (Hrs)"]},
    "soc_from": {"exact": ["Initial SOC"]},
    "soc_to": {"exact": ["Final SOC"]},
    "used": {"exact": ["% Used", "SOC Used"]},
    "energy": {"exact": ["Calc kWHh Used"]},
    "row_no": {"exact": ["row_no"]},
}


def daily_trips_sheet(sheet: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Trip rows with reported SOC use in either unit; unknown vehicles drop."""
    raw = resolve(normalize_headers(sheet), DAILY_TRIPS, "daily trips")

    def soc(c: str) -> Column:
        return p.soc_share_exact(p.number(F.col(c)))

    trips = raw.select(
        F.trim("code").alias("code"),
        p.day(F.col("day")).alias("date"),
        p.number(F.col("trip")).cast("int").alias("trip_num"),
        p.number(F.col("start_odo")).alias("init_odo"),
        p.number(F.col("end_odo")).alias("final_odo"),
        p.number(F.col("dist")).alias("tot_dist"),
        p.number(F.col("travel")).alias("tot_dura"),
        p.number(F.col("idle")).alias("idle_time"),
        soc("soc_from").alias("init_soc"),
        soc("soc_to").alias("final_soc"),
        soc("used").alias("soc_used"),
        p.number(F.col("energy")).alias("tot_energy"),
        F.col("row_no").cast("bigint").alias("row_no"),
    )
    days = trips_to_days(evaluated(trips), ["code", "date"], trip_order(), soc_used="reported")
    return resolve_key(days, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id", unmapped="drop").drop("code")


def daily_summary(sheets: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Q25: one sheet per vehicle (column ``sheet``), minutes, whole kWh, a total row. First row per key."""
    raw = data_rows(normalize_headers(sheets), F.col("Day"))

    def minutes(c: str) -> Column:
        return minutes_to_hours(p.number(F.col(f"`{c}`")))

    def soc(c: str) -> Column:
        return p.soc_share_clamped(p.number(F.col(c)))

    rows = raw.select(
        "sheet",
        p.day(F.col("Day")).alias("date"),
        p.number(F.col("Total Trips in Day")).cast("int").alias("trip_num"),
        p.number(F.col("Initial Odometer Reading")).alias("init_odo"),
        p.number(F.col("Final Odometer Reading")).alias("final_odo"),
        round_to(p.number(F.col("`Total Daily Distance Driven (miles)`")), 2).alias("tot_dist"),
        minutes("Total Daily Drive Duration (minutes)").alias("tot_dura"),
        minutes("Idle Time (minutes)").alias("idle_time"),
        soc("Initial SOC").alias("init_soc"),
        soc("Final SOC").alias("final_soc"),
        soc("Total SOC Used").alias("tot_soc_used"),
        half_even_int(p.number(F.col("`Total Energy Consumed for the Day (kWh)`"))).cast("double").alias("tot_energy"),
        F.col("row_no").cast("bigint").alias("row_no"),
    )
    rows = evaluated(rows).where("date is not null")
    mapped = resolve_key(rows, vehicle, {"sheet": "fleet_vehicle_id"}, "id", "veh_id", unmapped="drop").drop("sheet")
    return keep_last(mapped, ["veh_id", "date"], F.col("row_no").asc()).drop("row_no")


def payload(sheets: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Largest positive payload per vehicle and date."""
    wanted = {
        "date_text": {"exact": ["(2) Date (yyyy-mm-dd)"]},
        "load": {"exact": ["(11) Peak payload of the day (lbs)"]},
        "code": {"exact": ["(1) Vehicle ID (unique vehicle identifier)", "sheet"]},
    }
    raw = resolve(normalize_headers(sheets), wanted, "payload workbook")
    rows = raw.select(
        F.trim("code").alias("code"),
        p.day(F.col("date_text")).alias("date"),
        p.number(F.col("load")).alias("peak_payload"),
    )
    best = (
        positive_payload(evaluated(rows))
        .groupBy("code", "date")
        .agg(F.max(half_even_int(F.col("peak_payload"))).alias("peak_payload"))
    )
    return (
        resolve_key(best, vehicle, {"code": "fleet_vehicle_id"}, "id", "veh_id", unmapped="drop")
        .groupBy("veh_id", "date")
        .agg(F.max("peak_payload").alias("peak_payload"))
    )
