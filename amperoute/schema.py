"""Table schemas, as DDL text, and natural keys of the warehouse."""

from __future__ import annotations

from pyspark.sql import types as T


FLEET = (
    "id int, fleet_name string, fleet_size int, zev_tot int, zev_grant int, charger_grant int, "
    "depot_adr string, vendor_name string, latitude double, longitude double"
)
VEHICLE = (
    "id int, fleet_id int, fleet_vehicle_id string, make string, model string, year int, class int, "
    "curb_wt int, gross_wt int, rated_cap int, nominal_range int, nominal_eff double, battery_chem int, "
    "peak_power int, peak_torque int, towing_cap int, vocation string"
)
CHARGER = (
    "id int, fleet_id int, charger string, charger_type string, connector_type string, "
    "max_power_output int, dedicated_use boolean"
)
VEH_TEL = (
    "veh_id int, timestamp timestamp_ntz, elevation double, speed double, mileage double, soc double, "
    "key_on_time double, latitude double, longitude double"
)
VEH_DAILY = (
    "veh_id int, date date, trip_num int, init_odo double, final_odo double, tot_dist double, "
    "tot_dura double, idle_time double, init_soc double, final_soc double, tot_soc_used double, "
    "tot_energy double, peak_payload int"
)
REFUEL_INF = (
    "id bigint, charger_id int, veh_id int, connect_time timestamp_ntz, disconnect_time timestamp_ntz, "
    "refuel_start timestamp_ntz, refuel_end timestamp_ntz, avg_power double, max_power double, "
    "tot_energy double, start_soc double, end_soc double, tot_ref_dura double"
)
MAINTENANCE = (
    "id bigint, date date, maint_ob int, maint_categ string, maint_loc string, enter_shop timestamp_ntz, "
    "exit_shop timestamp_ntz, enter_odo int, exit_odo int, parts_cost decimal(12,2), "
    "labor_cost decimal(12,2), add_cost decimal(12,2), add_cost_desc string, warranty boolean, "
    "problem string, work_perf string, veh_id int, charger_id int"
)
EJ_AREA = "id bigint, ejarea boolean, geometry string"

TABLES = {
    "fleet": FLEET,
    "vehicle": VEHICLE,
    "charger": CHARGER,
    "veh_tel": VEH_TEL,
    "veh_daily": VEH_DAILY,
    "refuel_inf": REFUEL_INF,
    "maintenance": MAINTENANCE,
    "ej_area": EJ_AREA,
}


def struct(name: str) -> T.StructType:
    """A table's schema as a type; needs a running session."""
    return T.StructType.fromDDL(TABLES[name])


# A session is identified by its charger and the moment it was plugged in, or started when that is unknown.
KEYS = {
    "fleet": ["id"],
    "vehicle": ["fleet_id", "fleet_vehicle_id"],
    "charger": ["fleet_id", "charger"],
    "veh_tel": ["veh_id", "timestamp"],
    "veh_daily": ["veh_id", "date"],
    "refuel_inf": ["charger_id", "session_time"],
    "maintenance": ["veh_id", "enter_shop"],
}

# Columns a daily loader may overwrite; payload belongs to its own loader.
DAILY_VALUES = [
    "trip_num", "init_odo", "final_odo", "tot_dist", "tot_dura", "idle_time",
    "init_soc", "final_soc", "tot_soc_used", "tot_energy",
]
