"""Independent SQL for every registered query, for a single-node engine over the same parquet tables.

Texts here define what a query must return; they share only the view definitions with the engine.
"""

from __future__ import annotations

from .functions.labels import CHARGER_TYPE, CONNECTOR_TYPE
from .sources.views import view_sql

ORACLES: dict[str, str] = {}
TS = '"timestamp"'
LOCAL = "'America/New_York'"


def r(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(28,8)), {n}) as double)"


def add(name: str, views: str, body: str, *steps: tuple[str, str], recursive: bool = False) -> None:
    parts = [f"{v} as ({view_sql(v)})" for v in views.split()]
    parts += [f"{step} as ({text})" for step, text in steps]
    head = f"with {'recursive ' if recursive else ''}{', '.join(parts)} " if parts else ""
    ORACLES[name] = head + body


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0)"


def to_local(x: str) -> str:
    return f"(({x}) at time zone 'UTC' at time zone {LOCAL})"


def raw_utc(x: str) -> str:
    return f"(({x}) at time zone {LOCAL} at time zone 'UTC')"


def strict_utc(x: str, gap: str = "null", first: str = "null", second: str | None = None) -> str:
    """Local clock to UTC; skipped times give ``gap``, repeated ones the chosen pass."""
    u = raw_utc(x)
    twice_late = f"{to_local(u + ' - interval 1 hour')} = {x}"
    twice_early = f"{to_local(u + ' + interval 1 hour')} = {x}"
    early = f"case when {twice_late} then {u} - interval 1 hour else {u} end"
    repeated = {"null": "cast(null as timestamp)", "first": early, "second": f"({early}) + interval 1 hour"}[first]
    skipped = {"null": "cast(null as timestamp)", "shift": f"date_trunc('hour', {u})"}[gap]
    return (
        f"case when {to_local(u)} <> {x} then {skipped} when {twice_late} or {twice_early} then {repeated} else {u} end"
    )


# ---- vehicle days

_W1 = [
    ("s", f"""select veh_id, cast({TS} as date) as date, {TS} as ts, mileage, soc, coalesce(speed > 0, false) as mv,
        epoch_us(lead({TS}) over w) - epoch_us({TS}) as gap,
        count(*) filter (where speed > 0) over (partition by veh_id, cast({TS} as date) order by {TS} rows unbounded preceding) as island,
        count(*) filter (where speed > 0) over (partition by veh_id, cast({TS} as date)) as nm
        from veh_tel window w as (partition by veh_id, cast({TS} as date) order by {TS})"""),
    ("edge", "select veh_id, date, min(ts) filter (where mv) as f, max(ts) filter (where mv) as l from s group by all"),
    ("mid", """select s.*, ts >= f and ts < l as inside from s join edge using (veh_id, date)"""),
    ("stops", """select veh_id, date, island, max(nm) as nm, sum(gap) as stop from mid where not mv and island >= 1 and island <= nm - 2
        group by all having sum(gap) >= 900000000"""),
    ("breaks", "select veh_id, date, count(*) as n from stops group by all"),
    ("agg", """select veh_id, date, max(nm) as nm, arg_min(mileage, ts) filter (where true) as x,
        first(mileage order by ts) as init_odo, last(mileage order by ts) as final_odo,
        first(soc order by ts) filter (where soc is not null) as init_soc,
        last(soc order by ts) filter (where soc is not null) as final_soc,
        coalesce(sum(gap) filter (where inside and mv), 0) as drive,
        coalesce(sum(gap) filter (where inside and not mv), 0) as idle from mid group by all"""),
]
_VEH_DAY = f"""select veh_id, date, cast(case when nm = 0 then 0 else 1 + coalesce(n, 0) end as integer) as trip_num,
    init_odo, final_odo, {r('final_odo - init_odo', 2)} as tot_dist,
    {r('drive / 3600000000.0', 2)} as tot_dura, {r('idle / 3600000000.0', 2)} as idle_time, init_soc, final_soc,
    {r('case when init_soc - final_soc < 0 then 0 else init_soc - final_soc end', 4)} as tot_soc_used,
    cast(null as double) as tot_energy, cast(null as integer) as peak_payload
    from agg left join breaks using (veh_id, date)"""
add("q01_vehicle_day", "veh_tel", _VEH_DAY, *_W1)
add("k5_trips", "veh_tel", _VEH_DAY, *_W1)

_OF = [
    ("own", "select t.* from veh_tel t join vehicle v on v.id = t.veh_id where v.fleet_id in (0, 3, 5, 8, 12, 19, 20, 23)"),
    *[(n, x.replace("from veh_tel", "from own").replace("900000000", "3600000000")) for n, x in _W1],
]
add("q01_vehicle_day_of_fleets", "veh_tel vehicle", _VEH_DAY, *_OF)

# ---- charging

_LABEL = "case charger_type " + " ".join(f"when '{k}' then '{v}'" for k, v in CHARGER_TYPE.items()) + " else charger_type end"
_CHARGE = (
    "ch",
    f"""select r.*, fleet_name, {_LABEL} as kind,
    (end_soc * 100 - start_soc * 100) as gain,
    coalesce(tot_ref_dura, {minutes('refuel_start', 'refuel_end')}) as charging,
    {minutes('connect_time', 'disconnect_time')} as connecting,
    coalesce(refuel_start, connect_time) as cs, coalesce(refuel_end, disconnect_time) as ce,
    cast(coalesce(refuel_start, connect_time, refuel_end, disconnect_time) as date) as date
    from refuel_inf r join charger c on r.charger_id = c.id join fleet f on c.fleet_id = f.id""",
)
_CV = "refuel_inf charger fleet"
add("q02_charging_kpis", _CV, f"""select count(*) as events, {r('avg(tot_energy)', 2)} as avg_energy,
    {r('avg(charging)', 2)} as avg_charging_min, {r('avg(connecting)', 2)} as avg_connecting_min from ch""", _CHARGE)


def _summary(where: str) -> str:
    return f"""select fleet_name, kind as charger_type, count(id) as events, {r('coalesce(sum(tot_energy), 0)', 2)} as energy_kwh,
    {r('avg(charging)', 2)} as avg_charging_min, {r('avg(connecting)', 2)} as avg_connecting_min,
    {r('avg(avg_power)', 2)} as avg_power_kw, {r('avg(gain)', 2)} as avg_soc_gain
    from ch where fleet_name is not null and kind is not null and {where} group by 1, 2"""


_RECENT = "date between (select max(date) - 29 from ch) and (select max(date) from ch)"
add("q03_charging_summary", _CV, _summary("true"), _CHARGE)
add("q03_charging_summary_recent", _CV, _summary(_RECENT), _CHARGE)
add("q03_charging_summary_filtered", _CV, _summary("kind = 'DCFC' and date between '1996-01-01' and '2000-06-30'"), _CHARGE)
add("q04_daily_means", _CV, f"""select date, {r('avg(avg_power)', 4)} as avg_power, {r('avg(charging)', 4)} as charging_duration,
    {r('avg(connecting)', 4)} as connecting_duration from ch where date is not null group by date""", _CHARGE)
add("q05_hourly_starts_ends", _CV, """select event, hour, cast(coalesce(n, 0) as bigint) as n from
    (select cast(h as integer) as hour, e as event from range(24) a(h), (values ('Start'), ('End')) b(e))
    left join (select event, hour, count(*) as n from ev group by all) using (event, hour)""", _CHARGE,
    ("ev", f"""select 'Start' as event, cast(hour({to_local('cs')}) as integer) as hour from ch where cs is not null union all
    select 'End', cast(hour({to_local('ce')}) as integer) from ch where ce is not null"""))


def _matrix(where: str) -> tuple[str, tuple[str, str], tuple[str, str]]:
    cut = (
        "cut",
        f"""select unnest(generate_series(date_trunc('hour', cs), ce, interval 1 hour)) as b, cs, ce from ch where ce > cs and {where}""",
    )
    cell = (
        "cell",
        f"""select cast(isodow({to_local('b')}) - 1 as integer) as weekday, cast(hour({to_local('b')}) as integer) as hour,
        sum(epoch_us(least(ce, b + interval 1 hour)) - epoch_us(greatest(cs, b))) / 60000000.0 as m from cut group by all""",
    )
    body = f"""select weekday, hour, {r('coalesce(m, 0)', 4)} as minutes from
    (select cast(i // 24 as integer) as weekday, cast(i % 24 as integer) as hour from range(168) t(i)) left join cell using (weekday, hour)"""
    return body, cut, cell


_m = _matrix("true")
add("q06_weekday_hours", _CV, _m[0], _CHARGE, *_m[1:])
_m = _matrix(_RECENT)
add("q06_weekday_hours_recent", _CV, _m[0], _CHARGE, *_m[1:])

# ---- trips and usage

_PLACE = "place"


def _days(used: str = "case when init_soc - final_soc < 0 then 0 else init_soc - final_soc end", where: str = "true") -> str:
    return f"""select veh_id, date, max(trip_num) as trip_num,
    first(init_odo order by {_PLACE}) filter (where init_odo is not null) as init_odo,
    last(final_odo order by {_PLACE}) filter (where final_odo is not null) as final_odo,
    {r('coalesce(sum(tot_dist), 0)', 3)} as tot_dist, {r('coalesce(sum(tot_dura), 0)', 3)} as tot_dura,
    {r('coalesce(sum(idle_time), 0)', 3)} as idle_time,
    {r(f'first(init_soc order by {_PLACE}) filter (where init_soc is not null)', 4)} as init_soc,
    {r(f'last(final_soc order by {_PLACE}) filter (where final_soc is not null)', 4)} as final_soc,
    {r(f'coalesce(sum({used}), 0)', 4)} as tot_soc_used, {r('coalesce(sum(tot_energy), 0)', 3)} as tot_energy
    from veh_trip where {where} group by veh_id, date"""


add("q21_trip_days", "veh_trip", _days())
add("q21_trip_days_reported", "veh_trip", _days("soc_used"))
_DAILY = ("daily", _days())
_USE = (
    "u",
    """select d.* replace (tot_soc_used * 100 as tot_soc_used), coalesce(f.fleet_name, 'Unknown') as fleet,
    case when tot_dist >= 10 and tot_energy > 0 then tot_energy / tot_dist end as eff,
    coalesce(nullif(trim(v.make), ''), 'Unknown') as make, coalesce(nullif(trim(v.model), ''), 'Unknown') as model,
    coalesce(cast(v.class as string), 'Unknown') as class, coalesce(v.fleet_vehicle_id, 'Unknown') as code
    from daily d left join vehicle v on d.veh_id = v.id left join fleet f on v.fleet_id = f.id""",
)
_UV = "veh_trip vehicle fleet"


def _usage(where: str) -> str:
    return f"""select fleet, {r('sum(tot_dist)', 2)} as total_distance, avg(tot_dist) filter (where tot_dist > 0) as daily_distance,
    avg(tot_energy) filter (where tot_energy > 0) as daily_energy, sum(eff * tot_dist) / sum(tot_dist) filter (where eff is not null) as efficiency,
    avg(tot_soc_used) filter (where tot_soc_used > 0) as daily_soc_used, avg(tot_dura) filter (where tot_dura > 0) as daily_driving_time,
    avg(idle_time) as daily_idle_time from u where {where} group by fleet"""


_USE_COLS = ["total_distance", "daily_distance", "daily_energy", "efficiency", "daily_soc_used", "daily_driving_time", "daily_idle_time"]
_ROUNDED = "select fleet, " + ", ".join(f"{r(c, 4)} as {c}" for c in _USE_COLS) + " from t"
add("q07_fleet_usage", _UV, _ROUNDED, _DAILY, _USE, ("t", _usage("true")))
add("q07_fleet_usage_recent", _UV, _ROUNDED, _DAILY, _USE,
    ("t", _usage("date between (select max(date) - 29 from u) and (select max(date) from u)")))
add("q08_usage_headline", _UV, f"select {r('sum(total_distance)', 2)} as total_distance, " + ", ".join(
    f"{r(f'avg(coalesce({c}, 0))', 2)} as {c}" for c in ("daily_distance", "daily_energy", "daily_driving_time", "daily_soc_used")
) + " from t", _DAILY, _USE, ("t", _usage("true")))
add("q09_daily_metrics", "veh_trip", "select date, " + ", ".join(
    f"{r(f'{f}({c})', 4)} as {c.split(' ')[0]}" for f, c in (("sum", "tot_dist"), ("sum", "tot_energy"))
) + f""", {r('avg(tot_soc_used * 100)', 4)} as tot_soc_used, {r('sum(idle_time)', 4)} as idle_time,
    cast(null as double) as peak_payload, {r('avg(init_soc)', 4)} as init_soc, {r('avg(final_soc)', 4)} as final_soc,
    {r('sum(tot_dura)', 4)} as tot_dura from daily group by date""", _DAILY)
add("q10_daily_efficiency", _UV, f"""select date, {r('sum(eff * tot_dist) / sum(tot_dist)', 6)} as efficiency
    from u where eff is not null group by date""", _DAILY, _USE)
add("q20_usage_options", _UV, """select distinct option, value from (select 'fleet' as option, fleet as value from u
    union all select 'make', make from u union all select 'model', model from u union all select 'class', class from u
    union all select 'fleet_vehicle_id', code from u)""", _DAILY, _USE)
add("dq5_load_status", "veh_trip", "select count(*) as n_rows, max(date) as latest_date from daily", _DAILY)

# ---- maintenance

_MV = "maintenance vehicle charger fleet"
_OWN = (
    "m",
    """select e.*, coalesce(fv.fleet_name, fc.fleet_name) as fleet_name, v.fleet_vehicle_id, c.charger,
    parts_cost + labor_cost + add_cost as total_cost,
    case when maint_loc is null then 'Unknown' when lower(trim(maint_loc)) = 'in-house' then 'In-house' else 'Outsourced' end as loc
    from maintenance e left join vehicle v on e.veh_id = v.id left join fleet fv on v.fleet_id = fv.id
    left join charger c on e.charger_id = c.id left join fleet fc on c.fleet_id = fc.id""",
)
_STEPS = """select {g}veh_id, step from (select {g}veh_id, enter_odo - lag(enter_odo) over (partition by {g}veh_id order by date, id) as step
    from {t} where veh_id is not null and enter_odo is not null and date is not null) where step > 0"""
add("w04_service_intervals", "maintenance", f"select veh_id, {r('avg(step)', 4)} as avg_miles, count(*) as steps from st group by veh_id",
    ("st", _STEPS.format(g="", t="maintenance")))
add("q11_maintenance_kpis", "maintenance", f"""select count(*) as events, count(veh_id) as vehicle_events, count(charger_id) as charger_events,
    {r('avg(parts_cost + labor_cost + add_cost)', 2)} as avg_total_cost,
    (select {r('avg(a)', 2)} from (select avg(step) as a from st group by veh_id)) as avg_miles_between_services from maintenance""",
    ("st", _STEPS.format(g="", t="maintenance")))


def _table(scope: str, asset: str | None = None) -> tuple:
    steps = (
        ("sc", f"select * from m where {scope}"),
        ("st", _STEPS.format(g="fleet_name, ", t="sc")),
        ("mi", "select fleet_name, avg(a) as miles from (select fleet_name, veh_id, avg(step) as a from st group by all) group by all"),
        ("grid", "select * from (select distinct fleet_name from sc), (values ('Vehicle'), ('Charger')) t(asset_type)"),
        ("long", """select 'Vehicle' as asset_type, * from sc where veh_id is not null union all
            select 'Charger', * from sc where charger_id is not null or maint_ob = 2"""),
    )
    costs = ", ".join(
        f"{r(f'{f}(l.{c}) filter (where l.total_cost is not null)', 2)} as {n}"
        for f, c, n in (("sum", "total_cost", "total_cost"), ("avg", "total_cost", "avg_total_cost"), ("avg", "parts_cost", "avg_parts_cost"),
                        ("avg", "labor_cost", "avg_labor_cost"), ("avg", "add_cost", "avg_added_cost"))
    )
    body = f"""select coalesce(g.fleet_name, 'Unspecified') as fleet, g.asset_type, count(l.id) as events, {costs},
    {r("any_value(case when g.asset_type = 'Vehicle' then miles end)", 2)} as avg_miles_between_services
    from grid g left join long l on g.fleet_name is not distinct from l.fleet_name and g.asset_type = l.asset_type
    left join mi on mi.fleet_name is not distinct from g.fleet_name
    {f"where g.asset_type = '{asset}'" if asset else ''} group by g.fleet_name, g.asset_type"""
    return body, steps


_b, _s = _table("true")
add("q12_maintenance_table", _MV, _b, _OWN, *_s)
_ASSET = "(charger_id is not null or maint_ob = 2)"
_b, _s = _table(
    f"{_ASSET} and date between (select max(date) - 29 from m where {_ASSET}) and (select max(date) from m where {_ASSET})", "Charger"
)
add("q14_charger_scope_recent", _MV, _b, _OWN, *_s)
add("q14_fleet_scope", _MV, """select loc as label, count(*) as n from m where fleet_name in ('NATION_3', 'NATION_7')
    and date between '1997-01-01' and '1999-12-31' group by loc""", _OWN)
add("q13_category_share", "maintenance", """select case when n < 0.01 * (select sum(n) from c) then 'Other' else label end as label,
    cast(sum(n) as bigint) as n from c group by 1""",
    ("c", "select coalesce(maint_categ, 'Unspecified') as label, count(*) as n from maintenance group by 1"))
add("q13_warranty_share", "maintenance", "select case when warranty then 'Yes' else 'No' end as label, count(*) as n from maintenance group by 1")
add("q13_location_share", _MV, "select loc as label, count(*) as n from m group by 1", _OWN)
add("q20_asset_options", _MV, """select distinct 'vehicle' as asset_type, coalesce(fleet_vehicle_id, cast(veh_id as string)) as label, veh_id as id
    from m where veh_id is not null union all
    select distinct 'charger', coalesce(charger, cast(charger_id as string)), charger_id from m where charger_id is not null""", _OWN)

# ---- telematics

_TV = "veh_tel vehicle fleet"
_TEL = (
    "tel",
    """select t.*, f.fleet_name, v.fleet_vehicle_id from veh_tel t join vehicle v on t.veh_id = v.id join fleet f on v.fleet_id = f.id""",
)
_POS = "latitude between -90 and 90 and longitude between -180 and 180"
add("q15_telematics_kpis", "veh_tel", f"select {r('avg(speed)', 2)} as avg_speed, {r('max(speed)', 2)} as max_speed, count(*) as points from veh_tel")
_T16 = f"select count(*) as points, {r('avg(speed)', 2)} as avg_speed, {r('max(speed)', 2)} as max_speed from tel where {_POS}"
add("q16_telematics_summary", _TV, _T16, _TEL)
add("q16_telematics_summary_filtered", _TV,
    f"{_T16} and fleet_name = 'NATION_2' and {TS} >= '2024-01-05' and {TS} < '2024-01-21'", _TEL)
_TRACK = (
    "track",
    f"""select *, row_number() over (partition by veh_id order by {TS}) as seq, count(*) over (partition by veh_id) as points
    from tel where {_POS}""",
)
add("q17_tracks", _TV, f"""select veh_id, {TS}, latitude, longitude, points, seq, fleet_name, fleet_vehicle_id from track where points >= 2""", _TEL, _TRACK)
add("q17_track_pieces", _TV, f"""select veh_id, fleet_name, fleet_vehicle_id, (seq - 1) // 1000 as piece_no,
    string_agg(printf('%.4f %.4f', latitude, longitude), ';' order by {TS}) as line from track where points >= 2 group by 1, 2, 3, 4""", _TEL, _TRACK)
add("q27_recent_samples", _TV, f"select {TS}, speed, fleet_vehicle_id, fleet_name from tel order by {TS} desc, veh_id limit 100", _TEL)
add("a16_date_bounds", "maintenance", "select min(date) as start_date, max(date) as end_date from maintenance")
add("f06_latest_month", "veh_tel", f"select cast(max({TS}) as date) - 30 as start_date, cast(max({TS}) as date) as end_date from veh_tel")

# ---- fleets

add("q18_fleet_overview", "fleet charger", """select count(*) as fleets, cast(coalesce(sum(zev_grant), 0) as bigint) as granted_zevs,
    (select count(*) from charger) as chargers from fleet where latitude is not null and longitude is not null""")
add("q19_vehicle_models", "vehicle", """select fleet_id, make, model, year, count(*) as n from vehicle
    where fleet_id is not null and make is not null and model is not null and year is not null group by all""")


def _list_labels(column: str, labels: dict) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in labels.items())
    return (
        f"array_to_string(list_transform(list_filter(list_transform(string_split(coalesce({column}, ''), ','), lambda x: trim(x)), "
        f"lambda x: x <> ''), lambda x: case x {cases} else x end), ', ')"
    )


add("q19_charger_kinds", "charger", f"""select fleet_id, {_list_labels('charger_type', CHARGER_TYPE)} as charger_type_label,
    {_list_labels('connector_type', CONNECTOR_TYPE)} as connector_type_label, count(*) as n from charger group by 1, 2, 3""")
add("q20_charging_options", _CV, """select distinct 'fleet' as option, fleet_name as value from ch where fleet_name is not null
    union all select distinct 'charger_type', kind from ch where kind is not null""", _CHARGE)
add("q20_vehicle_options", "vehicle fleet", "select fleet_name, fleet_vehicle_id from vehicle v join fleet f on v.fleet_id = f.id")
add("w12_series_slots", "fleet", "select fleet_name, cast((row_number() over (order by fleet_name) - 1) % 24 as integer) as slot from fleet")

# ---- ordered operators

_HOURLY = ("h", f"select * replace (date_trunc('hour', {TS}) as {TS}) from veh_tel")
add("w09_keep_last", "veh_tel", f"""select veh_id, {TS}, id, speed from h
    qualify row_number() over (partition by veh_id, {TS} order by id desc) = 1""", _HOURLY)
add("w10_keep_best", "veh_tel", f"""select veh_id, {TS}, id, speed, details from
    (select * replace (case details when 'signup' then 'Ignition On' else details end as details) from h)
    qualify row_number() over (partition by veh_id, {TS} order by
        (case when speed > 0 then 4 else 0 end) + (case when lower(details) like '%ignition%' then 0 else 2 end)
        + (case when latitude is not null and longitude is not null then 1 else 0 end) desc, coalesce(speed, -1) desc, id desc) = 1""", _HOURLY)


def _mono(source: str, raw: str = "mileage", keep: str = "id, veh_id") -> tuple[tuple[str, str], ...]:
    """Back-fill, forward-fill, positive steps, running sum: first_value + sum of positive steps."""
    return (
        ("ff", f"""select *, last_value({raw} ignore nulls) over (partition by veh_id order by {TS} rows unbounded preceding) as filled,
            first_value({raw} ignore nulls) over (partition by veh_id order by {TS} rows between unbounded preceding and unbounded following) as start
            from {source}"""),
        ("bf", "select *, coalesce(filled, start) as v from ff"),
        ("dl", f"select *, greatest(v - lag(v) over (partition by veh_id order by {TS}), 0) as delta from bf"),
        ("mono", f"""select *, start + sum(coalesce(delta, 0)) over (partition by veh_id order by {TS} rows unbounded preceding) as rebuilt from dl"""),
    )


add("w05_monotonic_mileage", "veh_tel", f"select id, veh_id, {r('rebuilt', 4)} as rebuilt from mono", *_mono("veh_tel"))


def _asof(batch: str, stored: str) -> tuple[tuple[str, str], ...]:
    return (
        ("fst", f"select veh_id, min({TS}) as first_ts from {batch} group by 1"),
        ("anc", f"""select f.veh_id, f.first_ts, arg_max(s.mileage, s.{TS}) as anchor from fst f left join
            (select * from {stored} where mileage is not null) s on s.veh_id = f.veh_id and s.{TS} < f.first_ts group by 1, 2"""),
    )


add("j08_asof_anchor", "veh_tel", "select veh_id, first_ts, anchor from anc",
    ("b", f"select * from veh_tel where {TS} >= '2024-01-11'"), *_asof("b", "veh_tel"))
add("w06_anchored_mileage", "veh_tel", f"""select id, m.veh_id, {r('rebuilt + coalesce(anchor - start, 0)', 4)} as rebuilt
    from mono m join anc using (veh_id)""",
    ("b", f"select * from veh_tel where {TS} >= '2024-01-11'"), ("old", f"select * from veh_tel where {TS} < '2024-01-15'"),
    *_asof("b", "old"), *_mono("b"))


def _hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 3958.7613 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
    )


def _jumps(source: str) -> tuple[tuple[str, str], ...]:
    """Row-by-row walk: ay, ax is the anchor while inside a cluster, else null."""
    back = f"coalesce({_hav('w.ay', 'w.ax', 'n.y', 'n.x')} <= n.step, false)"
    inside = f"w.ay is not null and n.valid and not {back}"
    opens = "w.ay is null and n.valid and n.step > 5.0"
    return (
        ("pt", f"""select id, veh_id, latitude as y, longitude as x, row_number() over w as rn, lag(latitude) over w as py, lag(longitude) over w as px,
            epoch_us({TS}) - epoch_us(lag({TS}) over w) as dt from {source} window w as (partition by veh_id order by {TS})"""),
        ("pv", f"""select *, coalesce(y is not null and x is not null and py is not null and px is not null and dt > 0, false) as valid,
            {_hav('py', 'px', 'y', 'x')} as step from pt"""),
        ("walk", f"""select veh_id, rn, id, cast(null as double) as ay, cast(null as double) as ax, false as flag from pv where rn = 1
            union all select n.veh_id, n.rn, n.id,
            case when {inside} then w.ay when {opens} then n.py end, case when {inside} then w.ax when {opens} then n.px end,
            ({inside}) or ({opens}) from walk w join pv n on n.veh_id = w.veh_id and n.rn = w.rn + 1"""),
    )


add("w07_gps_jumps", "veh_tel", "select id, veh_id, flag as gps_outlier from walk", *_jumps("veh_tel"), recursive=True)


def _doubled(source: str, order: str) -> tuple[tuple[str, str], ...]:
    """Row-by-row walk: pm, ps is the last kept (corrected) reading."""
    def near(a: str, b: str) -> str:
        return f"coalesce(abs(({a}) - ({b})) <= 0.05 * greatest(abs({b}), 1e-9), false)"

    fm, fs = near("n.mileage - w.pm", "w.pm"), near("n.soc", "2 * w.ps")
    m = f"(case when {fm} then n.mileage / 2 else n.mileage end)"
    s = f"(case when {fs} then n.soc / 2 else n.soc end)"
    bad = f"coalesce({m} < 0, false) or coalesce({m} < w.pm * (1 - 0.05), false) or coalesce({s} < 0 or {s} > 1, false)"
    return (
        ("sr", f"""select *, row_number() over (partition by veh_id order by {order}) as rn from {source}
            where mileage is not null and veh_id is not null and {TS} is not null"""),
        ("fold", f"""select veh_id, cast(0 as bigint) as rn, cast(null as bigint) as id, cast(null as double) as pm, cast(null as double) as ps,
            false as kept, false as mileage_fixed, false as soc_fixed from sr where rn = 1
            union all select n.veh_id, n.rn, n.id, case when {bad} then w.pm else {m} end, case when {bad} then w.ps else {s} end,
            not ({bad}), {fm}, {fs} from fold w join sr n on n.veh_id = w.veh_id and n.rn = w.rn + 1"""),
    )


add("w08_doubled_readings", "veh_tel", """select id, veh_id, kept, mileage_fixed, soc_fixed, case when kept then pm end as mileage,
    case when kept then ps end as soc from fold where rn > 0""", *_doubled("veh_tel", f"{TS}, id"), recursive=True)

# ---- loads

_NAME = "concat('Customer#', lpad(cast({} as string), 9, '0'))"
_HOUR = f"date_trunc('hour', {TS})"
_SHEET_UTC = strict_utc("hr", gap="shift")
_REPORT = (
    ("raw", f"select *, {_HOUR} as hr from veh_tel"),
    ("rep", f"""select r.id, r.veh_id, {_SHEET_UTC} as {TS}, case when r.id % 101 = 3 then -4.5 else speed end as speed, mileage,
        case when r.id % 67 = 5 then null else {r('case when soc * 100 > 1 then soc * 100 / 100 else soc * 100 end', 4)} end as soc,
        case when r.id % 401 = 1 then 95.5 else latitude end as lat, longitude as lon,
        case details when 'signup' then 'Ignition On' else details end as details, v.id as known from raw r left join vehicle v on v.id = r.veh_id"""),
    ("ok", f"""select id, veh_id, {TS}, speed, mileage, soc, details,
        case when lat between -90 and 90 and lon between -180 and 180 then lat end as latitude,
        case when lat between -90 and 90 and lon between -180 and 180 then lon end as longitude
        from rep where {TS} is not null and known is not null and not coalesce(speed < 0, false)
        and not coalesce(soc < 0 or soc > 1, false) and not coalesce(mileage < 0, false)"""),
)
add("q22_report_samples", "veh_tel vehicle", f"""select veh_id, {TS}, speed, mileage, soc, latitude, longitude, details from ok
    qualify row_number() over (partition by veh_id, {TS} order by (case when speed > 0 then 4 else 0 end)
    + (case when lower(details) like '%ignition%' then 0 else 2 end)
    + (case when latitude is not null and longitude is not null then 1 else 0 end) desc, coalesce(speed, -1) desc, id desc) = 1""", *_REPORT)
add("dq6_rejections", "veh_tel vehicle", f"""select count(*) as rows_read, count(*) filter (where {TS} is null) as missing_timestamp,
    count(*) filter (where known is null) as unmapped_vehicle, count(*) filter (where speed < 0) as bad_speed,
    count(*) filter (where soc < 0 or soc > 1) as bad_soc, count(*) filter (where mileage < 0) as bad_mileage from rep""", *_REPORT[:2])
add("q22_fleet_file", "veh_tel vehicle", f"""select m.veh_id, m.{TS}, speed, case when not flag then latitude end as latitude,
    case when not flag then longitude end as longitude, {r('rebuilt + coalesce(anchor - start, 0)', 4)} as mileage
    from mono m join anc using (veh_id) join walk k on k.id = m.id""",
    ("raw", f"select *, {_HOUR} as hr from veh_tel where id % 503 <> 0"),
    ("utc", f"select r.* replace ({_SHEET_UTC} as {TS}) from raw r join vehicle v on v.id = r.veh_id"),
    ("uq", f"select * from utc where {TS} is not null qualify row_number() over (partition by veh_id, {TS} order by id desc) = 1"),
    *_asof("uq", "veh_tel"), *_jumps("uq"), *_mono("uq"), recursive=True)
add("dq6_fleet_file", "veh_tel vehicle", f"""select (select count(*) from veh_tel) as rows_read, (select count(*) from raw where {_SHEET_UTC} is null) as missing_timestamp,
    (select count(*) from veh_tel t left join vehicle v on v.id = t.veh_id and t.id % 503 <> 0 where v.id is null) as unmapped_vehicle,
    (select count(*) - count(distinct (veh_id, hr)) from raw r where veh_id in (select id from vehicle) and id % 503 <> 0) as duplicates_removed""",
    ("raw", f"select *, {_HOUR} as hr from veh_tel"))
add("dq6_repairs", "veh_tel", """select count(*) filter (where mileage_fixed) as mileage_fixed, count(*) filter (where soc_fixed) as soc_fixed,
    count(*) filter (where not kept) as dropped from fold where rn > 0""", *_doubled("veh_tel", f"{TS}, id"), recursive=True)
add("q22_telematics_sheet", "veh_tel vehicle", f"""select u.veh_id, u.{TS}, cast(u.id % 300 as double) as elevation, speed, pm as mileage, ps as soc,
    cast(null as double) as key_on_time, latitude, longitude from fold k join utc u on u.id = k.id
    where kept and rn > 0 and latitude between -90 and 90 and longitude between -180 and 180 and not coalesce(speed < 0, false)
    and not coalesce(ps < 0 or ps > 1, false)
    qualify row_number() over (partition by u.veh_id, u.{TS} order by u.id desc) = 1""",
    ("raw", f"select *, {_HOUR} as hr from veh_tel"),
    ("utc", f"""select r.* replace ({_SHEET_UTC} as {TS}, {r('soc * 100 / 100', 4)} as soc, case when r.id % 401 = 1 then 95.5 else latitude end as latitude)
        from raw r join vehicle v on v.id = r.veh_id"""),
    *_doubled("utc", f"{TS}, id"), recursive=True)
_UNIT_SOC = "case when id % 71 = 2 then 120.5 when id % 71 = 3 then -0.5 else soc * 100 end"
add("q22_vehicle_files", "veh_tel vehicle", f"""select {TS}, cast(null as double) as elevation, speed, mileage,
    {r("case when sv is null then null when sv > 1.000001 then least(sv / 100, 1) when sv < 0 then 0 else least(sv, 1) end", 4)} as soc,
    case when id % 9 = 0 then null else id / 8 end as key_on_time, latitude, longitude, veh_id from f
    qualify row_number() over (partition by veh_id, {TS} order by id) = 1""",
    ("f", f"select * replace ({_HOUR} + interval 5 hour as {TS}), {_UNIT_SOC} as sv from veh_tel where veh_id in (select id from vehicle)"))

_DUR = "(case when r.id % 10 = 0 then (tot_ref_dura / 1440) * 1440 else tot_ref_dura end)"
_PLUG = "join charger c on c.charger = concat('CH', cast(cast(floor(charger_id / 4) as bigint) as string), '-', cast(charger_id % 4 as string))"
add("q23_utc_sessions", _CV + " vehicle", f"""select refuel_start, refuel_end, tot_energy, {_DUR} as tot_ref_dura,
    cast(round(start_soc * 100) as integer) / 100 as start_soc, cast(round(end_soc * 100) as integer) / 100 as end_soc,
    {r(f'tot_energy * 60 / {_DUR}', 2)} as avg_power, c.id as charger_id,
    case when r.id % 6 in (0, 1) and r.id % 4 = 0 then null else v.id end as veh_id
    from refuel_inf r {_PLUG} left join vehicle v on v.id = r.veh_id
    where refuel_end > refuel_start and tot_ref_dura > 0 and tot_energy > 0""")
_LOC = (
    "loc",
    f"""select r.*, {strict_utc('connect_time')} as ct, {strict_utc("date_trunc('minute', disconnect_time)")} as dt,
    {strict_utc('refuel_start')} as rs, {strict_utc('refuel_end')} as re from refuel_inf r""",
)
_LMIN = r(minutes("rs", "re"), 2)
add("q23_local_sessions", _CV + " vehicle", f"""select ct as connect_time, dt as disconnect_time, rs as refuel_start, re as refuel_end,
    r.avg_power * 2 as max_power, tot_energy, cast(round(start_soc * 100) as integer) / 100 as start_soc,
    cast(round(end_soc * 100) as integer) / 100 as end_soc, {_LMIN} as tot_ref_dura, {r(f'tot_energy * 60 / {_LMIN}', 2)} as avg_power,
    c.id as charger_id, v.id as veh_id from loc r {_PLUG} left join vehicle v on v.id = r.veh_id
    where dt > ct and {_LMIN} > 0 and tot_energy > 0""", _LOC)


def _clamped(x: str) -> str:
    return r(f"greatest(0, least(1, case when {x} > 1.000001 then ({x}) / 100 else {x} end))", 4)


add("q23_session_list", _CV + " vehicle", f"""select ct as connect_time, dt as disconnect_time, {r(_DUR, 2)} as tot_ref_dura, tot_energy,
    r.avg_power as max_power, {_clamped('start_soc * 100')} as start_soc, {_clamped('end_soc')} as end_soc,
    {r(f'tot_energy * 60 / {r(_DUR, 2)}', 2)} as avg_power, c.id as charger_id, v.id as veh_id
    from loc r {_PLUG} join vehicle v on v.id = r.veh_id
    where dt > ct and tot_ref_dura > 0 and tot_energy > 0 and r.id % 12 <> 7""",
    ("loc", f"select r.*, {strict_utc('connect_time')} as ct, {strict_utc('disconnect_time')} as dt from refuel_inf r"))
add("q24_maintenance_sheet", "maintenance vehicle", f"""select maint_categ, maint_loc, enter_shop, exit_shop, cast(enter_odo as integer) as enter_odo,
    cast(enter_odo + 3 as integer) as exit_odo, {r('parts_cost', 2)} as parts_cost,
    case when m.id % 8 = 0 then null else {r('labor_cost', 2)} end as labor_cost, add_cost, case when m.id % 4 = 0 then 'towing' end as add_cost_desc,
    case when m.id % 5 = 0 then true when m.id % 5 in (1, 2) then false end as warranty, concat('problem ', m.id) as problem,
    concat('work ', m.id) as work_perf, v.id as veh_id, cast(enter_shop as date) as date, case when v.id is not null then 1 end as maint_ob
    from maintenance m left join vehicle v on v.id = m.veh_id""")
_STATION = "[Station-level C03]"
_WB_PROBLEM = """case when id % 6 = 0 then null when id % 6 = 3 then '[Station-level C03] seen' else concat('noise ', id) end"""
add("q24_maintenance_workbooks", "maintenance vehicle charger", f"""select
    case when id % 4 in (0, 1) then 'repair' when id % 4 = 2 then null else maint_categ end as maint_categ, maint_loc, enter_shop, exit_shop,
    cast(round_even(cast(enter_odo as double) + 0.5, 0) as integer) as enter_odo, cast(enter_odo + 2 as integer) as exit_odo,
    {r('parts_cost', 2)} as parts_cost, {r('labor_cost', 2)} as labor_cost,
    cast(case when id % 3 = 1 then 10.0 when id % 5 in (0, 1) then null else -1250.5 end as double) as add_cost,
    case when id % 3 = 1 then 'towing' when id % 5 = 0 then 'none so far' end as add_cost_desc, warranty,
    case when maint_ob = 2 and charger_id is null then
        case when contains(coalesce(pb, ''), '{_STATION}') then pb else trim(concat(coalesce(pb, ''), ' {_STATION}')) end else pb end as problem,
    case when id % 9 = 0 then null else concat('fixed ', id) end as work_perf, cast(enter_shop as date) as date, vid as veh_id, maint_ob, cid as charger_id
    from w""",
    ("w", f"""select m.*, case when m.maint_ob = 1 then v.id end as vid, case when m.maint_ob = 2 then c.id end as cid,
        case when m.id % 4 = 0 then concat('axle ', m.id, coalesce(': ' || p0, '')) else p0 end as pb
        from (select *, {_WB_PROBLEM} as p0 from maintenance) m left join vehicle v on v.id = m.veh_id
        left join charger c on c.id = m.charger_id and m.id % 36 <> 0
        where (m.maint_ob = 1 and v.id is not null) or (m.maint_ob = 2 and (c.id is not null or m.charger_id is null))"""))

_SHEET_DAY = """select r.id, r.veh_id // 100 as car, cast(connect_time as date) as date, case when r.id % 31 = 0 then null else cast(r.id % 7 as integer) end as trip_num,
    case when r.id % 7 = 0 then null else avg_power * 100 end as init_odo, case when r.id % 5 = 0 then null else avg_power * 100 + r.id % 50 end as final_odo,
    (r.id % 50) as dist, start_soc, end_soc, tot_energy, r.tot_ref_dura from refuel_inf r"""
_ORD = "coalesce(trip_num, 1048576), id"


def _sheet_days(dura: str, idle: str, soc_from: str, soc_to: str, used: str) -> str:
    return f"""select date, max(trip_num) as trip_num, first(init_odo order by {_ORD}) filter (where init_odo is not null) as init_odo,
    last(final_odo order by {_ORD}) filter (where final_odo is not null) as final_odo, {r('coalesce(sum(dist), 0)', 3)} as tot_dist,
    {r(f'coalesce(sum({dura}), 0)', 3)} as tot_dura, {r(f'coalesce(sum({idle}), 0)', 3)} as idle_time,
    {r(f'first({soc_from} order by {_ORD})', 4)} as init_soc, {r(f'last({soc_to} order by {_ORD})', 4)} as final_soc,
    {r(f'coalesce(sum({used}), 0)', 4)} as tot_soc_used, {r('coalesce(sum(tot_energy), 0)', 3)} as tot_energy, car as veh_id
    from sd group by date, car"""


add("q21_trip_report", "refuel_inf", _sheet_days(
    "case when id % 10 = 0 then (tot_ref_dura / 1440) * 1440 / 60 else tot_ref_dura / 60 end", "((id % 60) + 0.5) / 60", "end_soc", "(start_soc + 0.3)",
    "case when end_soc - (start_soc + 0.3) < 0 then 0 else end_soc - (start_soc + 0.3) end"), ("sd", _SHEET_DAY))


def _share(x: str) -> str:
    return f"(case when {x} > 1 then ({x}) / 100 else {x} end)"


add("q21_daily_trips_sheet", "refuel_inf", _sheet_days(
    "(id % 50) / 30", "(id % 10) / 100", _share("end_soc * 100"), _share("start_soc"), _share("(id % 40)")), ("sd", _SHEET_DAY))
_USED_SHEET = "case when id % 29 = 0 then 130 when id % 29 = 1 then -0.2 else end_soc - start_soc end"
add("q25_daily_summary", "refuel_inf", f"""select cast(connect_time as date) as date, cast(id % 7 as integer) as trip_num, avg_power * 100 as init_odo,
    avg_power * 100 + id % 50 as final_odo, {r('(id % 5000) / 7', 2)} as tot_dist,
    case when id % 23 = 0 then null else {r('(id % 613) / 60', 2)} end as tot_dura, {r('(id % 97) / 60', 2)} as idle_time,
    {_clamped('end_soc * 100')} as init_soc, {_clamped('start_soc')} as final_soc, {_clamped(_USED_SHEET)} as tot_soc_used,
    cast(round_even((id % 300) + 0.5, 0) as double) as tot_energy, veh_id // 100 as veh_id from refuel_inf where id % 97 <> 0
    qualify row_number() over (partition by veh_id // 100, cast(connect_time as date) order by id) = 1""")
_PAYLOAD = (
    "pay",
    """select veh_id, date, cast(max(round_even(init_odo / 4, 0)) as integer) as peak_payload from veh_trip
    where id % 13 not in (0, 1) and init_odo / 4 > 0 group by 1, 2""",
)
add("q26_payload", "veh_trip", "select veh_id, date, peak_payload from pay", _PAYLOAD)

# ---- scalar operators

add("c04_local_to_utc", "refuel_inf", f"""select id, {strict_utc('connect_time', 'shift')} as shifted, {strict_utc('connect_time')} as strict,
    {strict_utc('connect_time', 'shift', 'first')} as first_pass, {strict_utc('connect_time', 'shift', 'second')} as second_pass from refuel_inf""")
add("c16_cost_texts", "maintenance", """select id, case when id % 4 = 0 then cast(round(cast(labor_cost as decimal(28,8)), 2) as double)
    when id % 4 = 1 then cast(nullif(regexp_extract(maint_categ, '[0-9]+'), '') as double)
    when id % 4 = 2 then -cast(id as double) end as amount,
    case when id % 4 = 0 then concat('tow + ', id) when id % 4 = 1 then
        case when regexp_extract(maint_categ, '[0-9]+') = '' then maint_categ else nullif(trim(regexp_replace(maint_categ, '-?[0-9]+', '')), '') end
    when id % 4 = 2 then 'credit' end as note from maintenance""")
add("b06_vehicle_keys", "veh_trip vehicle", """select case when veh_id % 2 = 0 then concat('Customer#', lpad(cast(veh_id as string), 9, '0'))
    else concat('X', veh_id) end as code, count(*) as n, case when veh_id % 2 = 0 then (select id from vehicle v where v.id = t.veh_id) end as veh_id
    from veh_trip t group by t.veh_id""")

# ---- merges

_VALUES = ["trip_num", "init_odo", "final_odo", "tot_dist", "tot_dura", "idle_time", "init_soc", "final_soc", "tot_soc_used", "tot_energy"]
_OLD = ("o", f"select *, cast(null as integer) as peak_payload, true as here from ({_days(where="report <> 'R'")})")
_NEW = ("n", f"select *, cast(null as integer) as peak_payload, true as here from ({_days(where="report <> 'A'")})")


def _merged(value, action: bool = True) -> str:
    cols = ", ".join(f"{value(c)} as {c}" for c in _VALUES)
    diff = " or ".join(f"o.{c} is distinct from {value(c)}" for c in _VALUES)
    mark = f""", case when n.here is null then 'kept' when o.here is null then 'inserted' when {diff} then 'updated' else 'unchanged' end as merge_action"""
    return f"""select coalesce(o.veh_id, n.veh_id) as veh_id, coalesce(o.date, n.date) as date, {cols}, cast(null as integer) as peak_payload{mark if action else ''}
    from o full join n on o.veh_id = n.veh_id and o.date = n.date"""


add("j1_insert_absent", "veh_trip", _merged(lambda c: f"case when o.here then o.{c} else n.{c} end"), _OLD, _NEW)
_OVER = lambda c: f"case when n.here then n.{c} else o.{c} end"
add("j2_overwrite", "veh_trip", _merged(_OVER, False), _OLD, _NEW)
add("j3_changed_counts", "veh_trip", f"select merge_action, count(*) as n from ({_merged(_OVER)}) group by 1", _OLD, _NEW)
add("j5_fill_nulls", "veh_trip", _merged(lambda c: f"coalesce(o.{c}, n.{c})"), _OLD, _NEW)
add("j4_payload_only", "veh_trip", "select coalesce(o.veh_id, p.veh_id) as veh_id, coalesce(o.date, p.date) as date, "
    + ", ".join(f"o.{c}" for c in _VALUES) + """, p.peak_payload,
    case when p.veh_id is null then 'kept' when o.here is null then 'inserted' when p.peak_payload is not null then 'updated' else 'unchanged' end as merge_action
    from o full join pay p on o.veh_id = p.veh_id and o.date = p.date""", _OLD, _PAYLOAD)
add("j6_insert_unmatched", "maintenance", """select id, veh_id, enter_shop from maintenance t where not exists (
    select 1 from maintenance s where s.warranty is not null and s.veh_id = t.veh_id and s.enter_shop = t.enter_shop)""")
_EVENT = "date, maint_ob, maint_categ, maint_loc, enter_odo, warranty, veh_id, charger_id"
add("j7_insert_distinct", "maintenance", f"select {_EVENT} from maintenance except select {_EVENT} from maintenance where maint_loc is not null")
add("j8_unique_source", "veh_trip", """select veh_id, date, id, tot_dist from (
    select *, row_number() over (partition by veh_id, date order by place) as place_no from (
        select veh_id, case when id % 97 <> 0 then date end as date, id, tot_dist, place from veh_trip)) where date is null or place_no = 1""")
add("j9_without_fleet", _CV, """select charger_id, count(*) as n from refuel_inf where charger_id not in (
    select c.id from charger c join fleet f on c.fleet_id = f.id where fleet_name = 'NATION_3') group by 1""")
add("k3_overlap_counts", "veh_tel", f"""select count(*) as incoming, count(s.veh_id) as overlap_existing, count(*) - count(s.veh_id) as new_rows,
    count(*) filter (where s.veh_id is not null and i.details = 'view' and i.speed is not null) as changed_overlap,
    count(s.veh_id) - count(*) filter (where s.veh_id is not null and i.details = 'view' and i.speed is not null) as unchanged_overlap
    from (select * from veh_tel where details <> 'error') i left join (select * from veh_tel where details <> 'signup') s
    on i.veh_id = s.veh_id and i.{TS} = s.{TS}""")

# ---- data health

add("dq1_unmapped_chargers", "refuel_inf charger", """select charger_id, count(*) as n_rows from refuel_inf where charger_id is not null
    and charger_id not in (select id from charger) group by 1""")


def _orphan(name: str, table: str, key: str, dim: str) -> str:
    return f"select '{name}' as fact, '{key}' as key, (select count(*) from {table} t left join {dim} d on t.{key} = d.id where d.id is null) as orphans"


add("dq2_orphans", "veh_tel veh_trip refuel_inf maintenance vehicle charger", " union all ".join(
    _orphan(*x) for x in (
        ("veh_tel", "veh_tel", "veh_id", "vehicle"), ("veh_trip", "veh_trip", "veh_id", "vehicle"),
        ("refuel_inf.veh", "refuel_inf", "veh_id", "vehicle"), ("refuel_inf.charger", "refuel_inf", "charger_id", "charger"),
        ("maintenance", "maintenance", "veh_id", "vehicle"))))
_PER = (
    "per",
    f"""select 'telematics' as fact, fleet_name, max(cast({TS} as date)) as latest_date, count(*) as n_points
    from veh_tel t join vehicle v on t.veh_id = v.id join fleet f on v.fleet_id = f.id group by 2
    union all select 'sessions', fleet_name, max(cast(coalesce(connect_time, refuel_end, refuel_start) as date)), count(*)
    from refuel_inf t join charger c on t.charger_id = c.id join fleet f on c.fleet_id = f.id group by 2
    union all select 'daily', fleet_name, max(date), count(*) from daily t join vehicle v on t.veh_id = v.id join fleet f on v.fleet_id = f.id group by 2
    union all select 'maintenance', coalesce(fleet_name, 'Unspecified'), max(cast(exit_shop as date)), count(*) from m group by 2""",
)
_PV = "veh_tel refuel_inf veh_trip " + _MV
add("dq3_latest_per_fleet", _PV, "select fact, fleet_name, latest_date from per", _DAILY, _OWN, _PER)
add("dq4_rows_per_fleet", _PV, "select fact, fleet_name, n_points from per", _DAILY, _OWN, _PER)
add("dq4_rows_of_fleets", _PV, "select fact, fleet_name, n_points from per where fleet_name in ('NATION_1', 'NATION_9', 'Unspecified')", _DAILY, _OWN, _PER)
add("dq7_duplicate_codes", "vehicle", "select fleet_id, make, model, count(*) as n from vehicle group by all having count(*) > 1")


add("b06_codes_of_two_fleets", "veh_trip vehicle", """select s.fleet_id, s.unit, s.n, c.id as veh_id from s left join c on c.fleet_id = s.fleet_id and c.unit = s.unit""",
    ("c", "select fleet_id, concat('V', cast(id % 50 as string)) as unit, min(id) as id from vehicle group by 1, 2"),
    ("s", "select veh_id % 26 as fleet_id, concat('V', cast(veh_id % 50 as string)) as unit, count(*) as n from veh_trip where veh_id is not null group by 1, 2"))
add("b10_fill_dimension", "vehicle", """select fleet_id, fleet_vehicle_id, case when id % 3 <> 0 and id % 5 <> 0 and make is not null then make
    else concat('seed ', coalesce(make, '-')) end as make, case when id % 3 <> 0 then model else concat('seed ', model) end as model from vehicle""")
add("b11_rekey", "veh_trip vehicle", "select v.id as veh_id, count(*) as n from veh_trip t join vehicle v on v.id = t.veh_id group by 1")
add("c30_points", "veh_tel", """select id, case when latitude is not null then longitude end as lon, case when longitude is not null then latitude end as lat,
    latitude is null or longitude is null as nowhere from veh_tel""")
_SESSION = ["refuel_end", "tot_energy", "start_soc", "end_soc", "veh_id"]
add("q23_sessions_merged", _CV + " vehicle", "select coalesce(o.charger_id, n.charger_id) as charger_id, coalesce(o.refuel_start, n.refuel_start) as refuel_start, "
    + ", ".join(f"case when n.here then n.{c} else o.{c} end as {c}" for c in _SESSION)
    + ", case when n.here is null then 'kept' when o.here is null then 'inserted' when "
    + " or ".join(f"n.{c} is distinct from o.{c}" for c in _SESSION)
    + " then 'updated' else 'unchanged' end as merge_action from o full join n on o.charger_id = n.charger_id and o.refuel_start = n.refuel_start",
    ("l", "select charger_id, refuel_start, " + ", ".join(_SESSION) + f""" from (select refuel_start, refuel_end, tot_energy,
        cast(round(start_soc * 100) as integer) / 100 as start_soc, cast(round(end_soc * 100) as integer) / 100 as end_soc, c.id as charger_id,
        case when r.id % 6 in (0, 1) and r.id % 4 = 0 then null else v.id end as veh_id
        from refuel_inf r {_PLUG} left join vehicle v on v.id = r.veh_id where refuel_end > refuel_start and tot_ref_dura > 0 and tot_energy > 0)"""),
    ("n", "select *, true as here from l qualify row_number() over (partition by charger_id, refuel_start order by "
        + ", ".join(f"{c} nulls first" for c in _SESSION) + ") = 1"),
    ("o", "select charger_id, refuel_start, " + ", ".join(_SESSION) + ", true as here from refuel_inf where id % 3 <> 0"))
add("q22_samples_merged", "veh_tel vehicle", f"""select coalesce(o.veh_id, n.veh_id) as veh_id, coalesce(o.{TS}, n.{TS}) as {TS}, coalesce(o.speed, n.speed) as speed,
    coalesce(o.mileage, n.mileage) as mileage, coalesce(o.soc, n.soc) as soc,
    case when n.here is null then 'kept' when o.here is null then 'inserted' when (o.speed is null and n.speed is not null) or (o.mileage is null and n.mileage is not null)
    or (o.soc is null and n.soc is not null) then 'updated' else 'unchanged' end as merge_action
    from o full join n on o.veh_id = n.veh_id and o.{TS} = n.{TS}""", *_REPORT,
    ("n", f"""select veh_id, {TS}, speed, mileage, soc, true as here from (select * from ok
    qualify row_number() over (partition by veh_id, {TS} order by (case when speed > 0 then 4 else 0 end)
    + (case when lower(details) like '%ignition%' then 0 else 2 end)
    + (case when latitude is not null and longitude is not null then 1 else 0 end) desc, coalesce(speed, -1) desc, id desc) = 1)"""),
    ("o", f"""select veh_id, {TS}, speed + 1 as speed, mileage, case when hour({TS}) % 4 = 0 then soc end as soc, true as here from n where hour({TS}) % 2 = 0
    union all select veh_id, {TS} + interval 400 day, speed, mileage, soc, true from veh_tel where id % 50 = 0"""))
add("c05_repeated_hours", "veh_tel", """select id, veh_id, case when not twice then local + case when local < '2024-11-03 01:00' then interval 4 hour else interval 5 hour end
    when any_step = 1 then local + case when run = 0 then interval 4 hour else interval 5 hour end end as utc from d""",
    ("a", "select id, veh_id, timestamp '2024-11-03' + to_minutes(cast(id % 240 as bigint)) as local from veh_tel"),
    ("b", "select *, local >= '2024-11-03 01:00' and local < '2024-11-03 02:00' as twice from a"),
    ("c", "select *, coalesce(cast(lag(local) over (partition by veh_id, twice order by id) > local as integer), 0) as step from b"),
    ("d", "select *, max(step) over (partition by veh_id, twice) as any_step, max(step) over (partition by veh_id, twice order by id) as run from c"))
