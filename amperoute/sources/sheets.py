"""Vendor-shaped text sheets written from the domain views, for running the loads on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.staging import evaluated
from .views import Tables

_NAME = "concat('Customer#', lpad(cast({} as string), 9, '0'))"


def _written(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns that, like a file's, exist before anything reads them."""
    return evaluated(df.selectExpr(*columns))


def _clock(column: str, layout: str = "yyyy-MM-dd HH:mm:ss") -> str:
    return f"date_format({column}, '{layout}')"


def report_sheet(t: Tables) -> DataFrame:
    return _written(
        t.veh_tel,
        "concat(' VIN', veh_id, ' ') as `Vehicle ID `",
        _clock("timestamp", "yyyy-MM-dd HH:00:00") + " as `Date/Time`",
        "case when id % 401 = 1 then '95.5' else string(latitude) end as Latitude",
        "string(longitude) as Longitude",
        "case when id % 101 = 3 then '-4.5' else string(speed) end as `Speed\n(mph)`",
        "case when id % 67 = 5 then 'n/a' else string(soc * 100) end as `State of Charge`",
        "string(mileage) as Odometer",
        "case details when 'signup' then 'Ignition On' else details end as Details",
        "id as row_no",
    )


def serial_codes(t: Tables) -> DataFrame:
    return _written(
        t.vehicle,"concat('VIN', id) as vin", "fleet_vehicle_id")


def fleet_file(t: Tables) -> DataFrame:
    return _written(
        t.veh_tel,
        _clock("timestamp", "M/d/yyyy") + " as Date",
        _clock("timestamp", "H:00:00") + " as `Time(EST)`",
        f"case when id % 503 = 0 then 'unknown' else {_NAME.format('veh_id')} end as `Asset No.`",
        "string(speed) as `Speed(MPH)`",
        "string(mileage) as `Distance Traveled(Miles)`",
        "string(latitude) as Lat",
        "string(longitude) as Lon",
        "id as row_no",
    )


def telematics_sheet(t: Tables) -> DataFrame:
    return _written(
        t.veh_tel,
        _clock("timestamp", "yyyy-MM-dd HH:00:00") + " as `Data Timestamp`",
        f"{_NAME.format('veh_id')} as `Vehicle ID`",
        "string(speed) as Speed",
        "string(mileage) as Odometer",
        "case when id % 401 = 1 then '95.5' else string(latitude) end as Latitude",
        "string(longitude) as Longitude",
        "string(id % 300) as Elevation",
        "string(soc * 100) as `State Of Charge`",
        "string(null) as `Total Travel Time (Hrs)`",
        "id as row_no",
    )


def vehicle_files(t: Tables) -> DataFrame:
    return _written(
        t.veh_tel,
        f"{_NAME.format('veh_id')} as code",
        "'unit' as name",
        "concat(" + _clock("timestamp", "yyyy-MM-dd HH:00:00") + ", '-05:00') as timeStamp",
        "string(latitude) as latitude",
        "string(longitude) as longitude",
        "string(speed) as speed",
        "string(mileage) as odometer",
        "case when id % 71 = 2 then '120.5' when id % 71 = 3 then '-0.5' else string(soc * 100) end as stateOfCharge",
        "case when id % 9 = 0 then 'bad' else string(id / 8) end as keyOnTime",
        "id as row_no",
    )


_DURATION = (
    "case when id % 10 = 0 then string(tot_ref_dura / 1440) "
    "else concat(lpad(string(int(floor(tot_ref_dura / 60))), 2, '0'), ':', "
    "lpad(string(int(tot_ref_dura) % 60), 2, '0'), ':00') end"
)


def utc_sessions(t: Tables) -> DataFrame:
    name = _NAME.format("veh_id")
    return _written(
        t.refuel_inf,
        "concat(' CH', bigint(floor(charger_id / 4)), ' ') as `Serial Number`",
        "string(charger_id % 4) as `Connector Number`",
        f"case when id % 6 = 0 then null when id % 6 = 1 then ' ?' else concat(lower({name}), ' ?') end as `Tractor ID`",
        f"case when id % 4 = 0 then null else {name} end as `Tractor Number`",
        "concat(" + _clock("refuel_start") + ", '+00:00') as `Session Start Time`",
        "concat(" + _clock("refuel_end") + ", '+00:00') as `Session Stop Time`",
        "string(tot_energy) as `Energy Delivered (kWh)`",
        f"{_DURATION} as Duration",
        "concat(string(int(round(start_soc * 100))), '%') as `Battery State Of Charge At Session Start`",
        "string(int(round(end_soc * 100))) as `Battery State Of Charge At Session Stop`",
    )


def local_sessions(t: Tables) -> DataFrame:
    return _written(
        t.refuel_inf,
        "concat('CH', bigint(floor(charger_id / 4)), ':box') as `Charger ID`",
        "string(charger_id % 4) as Port",
        f"{_NAME.format('veh_id')} as `Vehicle ID`",
        _clock("connect_time") + " as `Connect Time`",
        _clock("disconnect_time", "M/d/yyyy h:mm a") + " as `Disconnect Time`",
        _clock("refuel_start") + " as `Charge Start Time`",
        _clock("refuel_end") + " as `Charge End Time`",
        "string(avg_power * 2) as `Peak Power`",
        "string(tot_energy) as `Energy Dispensed`",
        "concat(string(int(round(start_soc * 100))), '%') as `Vehicle SoC at start of Charging`",
        "concat(string(int(round(end_soc * 100))), ' %') as `Vehicle SoC at end of Charging`",
    )


def session_list(t: Tables) -> DataFrame:
    return _written(
        t.refuel_inf,
        "concat(' CH', bigint(floor(charger_id / 4)), '-', charger_id % 4) as Connector",
        f"case when id % 12 = 7 then null else concat({_NAME.format('veh_id')}, ' :sha256:', id) end as `Vehicle ID `",
        _clock("connect_time") + " as `Session start (America/New_York)`",
        _clock("disconnect_time") + " as `Session end (America/New_York)`",
        f"{_DURATION} as `Charging duration (hh:mm:ss)`",
        "string(tot_energy) as `Charged Energy (kWh)`",
        "string(avg_power) as `Peak power (kW)`",
        "string(start_soc * 100) as `Battery level at start (%)`",
        "string(end_soc) as `Battery level at end (%)`",
    )


def maintenance_sheet(t: Tables) -> DataFrame:
    return _written(
        t.maintenance,
        f"case when veh_id is null then 'yard' else {_NAME.format('veh_id')} end as `Vehicle ID`",
        "maint_categ as Category",
        "maint_loc as Location",
        _clock("enter_shop", "M/d/yyyy HH:mm") + " as `Date to Shop`",
        _clock("exit_shop") + " as `Date Returned`",
        "string(enter_odo) as `Start Odometer`",
        "string(enter_odo + 3) as `Returned Odometer`",
        "string(parts_cost) as `Parts Costs`",
        "case when id % 8 = 0 then 'pending' else string(labor_cost) end as `Labor Costs`",
        "string(add_cost) as `Added Costs`",
        "case when id % 4 = 0 then 'towing' end as `Added Costs Desc`",
        "case when id % 5 = 0 then ' Yes ' when id % 5 = 1 then 'F' when id % 5 = 2 then '0' "
        "when id % 5 = 3 then 'maybe' end as `Warranty Coverage?`",
        "concat('problem ', id) as `Desc of Problem`",
        "concat('work ', id) as `Desc of Work Done`",
    )


def maintenance_workbook(t: Tables, asset: str) -> DataFrame:
    """Rows of one asset type; every third event is the charger workbook's."""
    mine = t.maintenance.where("maint_ob = 1" if asset == "vehicle" else "maint_ob = 2")
    code = _NAME.format("veh_id") if asset == "vehicle" else (
        "case when charger_id is null then 'C03' when id % 36 = 0 then 'C99' "
        "else concat('CH', bigint(floor(charger_id / 4)), '-', charger_id % 4) end"
    )
    return _written(
        mine,
        f"concat(' ', {code}) as `Vehicle ID (unique identifier)`",
        "case when id % 4 = 0 then concat(' repair: axle ', id) when id % 4 = 1 then 'repair:' "
        "when id % 4 = 2 then ' ' else maint_categ end as `Maintenance category (identify all\n that apply)`",
        "case when id % 6 = 0 then null when id % 6 = 3 then '[Station-level C03] seen' else concat('noise ', id) end "
        "as `If diagnostic or repair work, description of the condition or problem`",
        "case when id % 9 = 0 then ' ' else concat(' fixed ', id) end as `Description of the work performed`",
        "maint_loc as `Maintenance work performed in-house or outsourced?`",
        _clock("enter_shop", "yyyy-MM-dd HH:mm") + " as `The timestamp when vehicle entered the shop (yyyy-mm-dd hh24:mm)`",
        _clock("exit_shop", "yyyy-MM-dd HH:mm") + " as `The timestamp when vehicle exited the shop (yyyy-mm-dd hh24:mm)`",
        "string(enter_odo + 0.5) as `Odometer reading upon entering  shop (miles)`",
        "string(enter_odo + 2) as `Odometer reading upon exiting shop (miles)`",
        "concat('$', format_number(round(cast(parts_cost as decimal(28,8)), 2), 2)) as `Parts cost ($)`",
        "concat(string(labor_cost), ' USD') as `Labor cost ($)`",
        "case when id % 3 = 1 then concat('$', int(add_cost), ' (towing)') when id % 5 = 0 then 'none so far' "
        "when id % 5 = 1 then ' ' else '(-1,250.50)' end as `Additional costs, if any ($) (please describe)`",
        "case when warranty then 'Yes' when not warranty then 'no' end as `Warranty covered (yes or no).`",
    )


def trip_report(t: Tables) -> DataFrame:
    """Trips from sessions: the sheet's rows have a unique place."""
    return _written(
        t.refuel_inf,
        "concat('VIN', bigint(floor(veh_id / 100))) as `Vehicle ID`",
        "case when id % 31 = 0 then null else string(id % 7) end as Trip",
        _clock("connect_time", "M/d/yyyy") + " as Date",
        "case when id % 7 = 0 then null else string(avg_power * 100) end as `Begin Odometer`",
        "case when id % 5 = 0 then 'n/a' else string(avg_power * 100 + id % 50) end as `End Odometer`",
        "concat('0:', lpad(string(id % 60), 2, '0'), ':30') as `Idling Duration`",
        f"{_DURATION} as `Driving Duration`",
        "string(id % 50) as Distance",
        "string(end_soc) as `Beginning State Of Charge`",
        "string(start_soc + 0.3) as `Ending State Of Charge`",
        "string(tot_energy) as `Total kWh used`",
        "id as row_no",
    )


def daily_trips(t: Tables) -> DataFrame:
    return _written(
        t.refuel_inf,
        f"concat({_NAME.format('bigint(floor(veh_id / 100))')}, ' ') as `Vehicle ID`",
        _clock("connect_time", "yyyy-MM-dd") + " as Date",
        "case when id % 31 = 0 then null else string(id % 7) end as `Trip Nbr`",
        "case when id % 7 = 0 then null else string(avg_power * 100) end as `Start Odometer`",
        "case when id % 5 = 0 then 'n/a' else string(avg_power * 100 + id % 50) end as `End Odometer`",
        "string(id % 50) as `Distance Traveled`",
        "string((id % 50) / 30) as `Total Travel Time (Hrs)`",
        "string((id % 10) / 100) as `Total Idle Time`",
        "string(end_soc * 100) as `Initial SOC`",
        "string(start_soc) as `Final SOC`",
        "string(id % 40) as `% Used`",
        "string(tot_energy) as `Calc kWHh Used`",
        "id as row_no",
    )


def daily_summary(t: Tables) -> DataFrame:
    return _written(
        t.refuel_inf,
        f"{_NAME.format('bigint(floor(veh_id / 100))')} as sheet",
        "case when id % 97 = 0 then 'Grand Total' else " + _clock("connect_time", "yyyy-MM-dd") + " end as Day",
        "string(id % 7) as `Total Trips in  Day`",
        "string(avg_power * 100) as `Initial Odometer Reading`",
        "string(avg_power * 100 + id % 50) as `Final Odometer Reading`",
        "string((id % 5000) / 7) as `Total Daily Distance\nDriven (miles)`",
        "case when id % 23 = 0 then '-' else string(id % 613) end as `Total Daily Drive Duration (minutes)`",
        "string(id % 97) as `Idle Time (minutes)`",
        "string(end_soc * 100) as `Initial SOC`",
        "string(start_soc) as `Final SOC`",
        "case when id % 29 = 0 then '130' when id % 29 = 1 then '-0.2' else string(end_soc - start_soc) end as `Total SOC Used`",
        "string((id % 300) + 0.5) as `Total Energy Consumed for the Day (kWh)`",
        "id as row_no",
    )


def payload_sheets(t: Tables) -> DataFrame:
    return _written(
        t.veh_trip,
        f"{_NAME.format('veh_id')} as sheet",
        "string(date) as ` (2) Date (yyyy-mm-dd)`",
        "case when id % 13 = 0 then 'n/a' when id % 13 = 1 then '-20' else string(init_odo / 4) end "
        "as `(11) Peak payload of the day (lbs)`",
    )
