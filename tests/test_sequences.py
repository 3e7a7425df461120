"""Ordered operators against plain sequential folds on random and edge-case series."""

import math
import random
from datetime import date, datetime, timedelta

import pytest

from amperoute.operators import ordered_fold, sequences
from amperoute.operators.joins import asof_anchor

START = datetime(2024, 3, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- W1-W3


def fold_day(rows, threshold=900.0):
    rows = sorted(rows)
    moving = [i for i, r in enumerate(rows) if (r[3] or 0) > 0]
    drive = idle = 0.0
    trips = 0
    if moving:
        trips, stop, was_moving = 1, 0.0, False
        for i in range(moving[0], moving[-1]):
            gap = (rows[i + 1][0] - rows[i][0]).total_seconds()
            if i in moving:
                drive += gap
                trips += (not was_moving) and stop >= threshold
                stop, was_moving = 0.0, True
            else:
                idle, stop, was_moving = idle + gap, stop + gap, False
    return trips, drive, idle


@pytest.mark.parametrize("slice_minutes", [15, 60, 1440])
def test_vehicle_day_equals_sequential_fold(spark, slice_minutes):
    rng = random.Random(slice_minutes)
    rows = []
    for veh in range(60):
        t = START
        for _ in range(rng.randint(1, 60)):
            t += timedelta(seconds=rng.choice([30, 60, 300, 899, 900, 901, 2400]))
            rows.append((veh, t, rng.choice([None, rng.random() * 100]), rng.choice([None, rng.random()]), rng.choice([None, 0.0, 0.0, 35.0])))
    tel = frame(spark, rows, "veh_id int, timestamp timestamp_ntz, mileage double, soc double, speed double")
    got = {(r.veh_id, r.date): r for r in sequences.vehicle_day(tel, slice_minutes=slice_minutes).collect()}
    days = {}
    for veh, t, mileage, soc, speed in rows:
        days.setdefault((veh, t.date()), []).append((t, mileage, soc, speed))
    assert set(got) == set(days)
    for key, day in days.items():
        day.sort(key=lambda r: r[0])
        trips, drive, idle = fold_day(day)
        row = got[key]
        socs = [r[2] for r in day if r[2] is not None]
        assert row.trip_num == trips
        assert row.tot_dura == pytest.approx(drive / 3600, abs=0.0051)
        assert row.idle_time == pytest.approx(idle / 3600, abs=0.0051)
        assert (row.init_odo, row.final_odo) == (day[0][1], day[-1][1])
        assert row.init_soc == (socs[0] if socs else None)
        assert row.final_soc == (socs[-1] if socs else None)
        if socs:
            assert row.tot_soc_used == pytest.approx(max(socs[0] - socs[-1], 0), abs=5.1e-5)


def test_long_stop_before_last_moving_sample_opens_no_trip(spark):
    t = [START + timedelta(minutes=m) for m in (0, 1, 60, 61, 120)]
    rows = [(1, t[0], 9.0), (1, t[1], 0.0), (1, t[2], 9.0), (1, t[3], 0.0), (1, t[4], 9.0)]
    tel = frame(spark, [(v, ts, None, None, s) for v, ts, s in rows], "veh_id int, timestamp timestamp_ntz, mileage double, soc double, speed double")
    assert sequences.vehicle_day(tel).first().trip_num == 2


# ---- W5, W6


def test_monotonic_mileage_equals_sequential_fold(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for veh in range(20):
        counter, t, filled = 0.0, START, None
        series = []
        for _ in range(200):
            t += timedelta(minutes=rng.randint(1, 400))
            counter = 0.0 if rng.random() < 0.05 else counter + rng.randint(0, 9)
            series.append((t, None if rng.random() < 0.2 else counter))
        known = [v for _, v in series if v is not None]
        value = known[0]
        for t, raw in series:
            if raw is not None:
                value += max(raw - filled, 0) if filled is not None else 0
                filled = raw
            expected[veh, t] = value
            rows.append((veh, t, raw))
    rows += [(99, START, None), (99, START + timedelta(days=2), None)]
    tel = frame(spark, rows, "veh_id int, timestamp timestamp_ntz, mileage_raw double")
    got = {(r.veh_id, r.timestamp): r.mileage for r in sequences.monotonic_mileage(tel).collect()}
    assert len(got) == len(rows)
    assert all(got.pop((99, t)) is None for t in (START, START + timedelta(days=2)))
    assert got == expected
    anchors = frame(spark, [(0, 1000.0), (1, None)], "veh_id int, anchor double")
    moved = {(r.veh_id, r.timestamp): r.mileage for r in sequences.monotonic_mileage(tel, anchors=anchors).collect()}
    first = min(t for v, t in expected if v == 0)
    assert moved[0, first] == 1000.0
    assert {k: v for k, v in moved.items() if k[0] == 1} == {k: v for k, v in expected.items() if k[0] == 1}


def test_asof_anchor_looks_strictly_before(spark):
    stored = frame(
        spark,
        [(1, START, 10.0), (1, START + timedelta(days=1), 20.0), (1, START + timedelta(days=1, hours=1), None),
         (1, START + timedelta(days=1, hours=2), 30.0), (2, START + timedelta(days=9), 5.0)],
        "veh_id int, timestamp timestamp_ntz, mileage double",
    )
    batch = frame(spark, [(1, START + timedelta(days=1, hours=2)), (2, START)], "veh_id int, timestamp timestamp_ntz")
    assert {r.veh_id: r.anchor for r in asof_anchor(batch, stored).collect()} == {1: 20.0, 2: None}


# ---- W7


def miles(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.7613 * math.asin(math.sqrt(x))


def walk_jumps(points):
    flags, anchor, before = [], None, None
    for t, lat, lon in points:
        here = None if lat is None or lon is None else (lat, lon)
        usable = here and before and before[1] and t > before[0]
        flag = False
        if not usable:
            anchor = None
        elif anchor:
            flag = miles(anchor, here) > miles(before[1], here)
            anchor = anchor if flag else None
        elif miles(before[1], here) > 5.0:
            flag, anchor = True, before[1]
        flags.append(flag)
        before = (t, here)
    return flags


def test_gps_jumps_equal_sequential_walk(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for veh in range(25):
        t, lat, lon, away = START, 40.0, -77.0, 0
        points = []
        for _ in range(120):
            t += timedelta(minutes=rng.randint(10, 200))
            lat, lon = lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.02)
            if rng.random() < 0.04:
                away = 0 if away else rng.choice([0.5, 1.5, -2.0])
            if rng.random() < 0.01:
                lat += 0.3  # a move that is never taken back
            none = rng.random() < 0.01
            points.append((t, None if none else lat + away, lon))
        for p, flag in zip(points, walk_jumps(points)):
            rows.append((veh, *p))
            expected[veh, p[0]] = flag
    track = frame(spark, rows, "veh_id long, timestamp timestamp_ntz, latitude double, longitude double")
    got = ordered_fold.flag_gps_jumps(track).collect()
    assert len(got) == len(rows)
    assert {(r.veh_id, r.timestamp): r.gps_outlier for r in got} == expected
    assert any(expected.values())


def test_gps_jump_nulls_only_positions(spark):
    rows = [(1, START + timedelta(minutes=i), lat, -77.0, 3.0) for i, lat in enumerate([40.0, 41.0, 40.01])]
    track = frame(spark, rows, "veh_id long, timestamp timestamp_ntz, latitude double, longitude double, speed double")
    got = sorted(ordered_fold.null_gps_jumps(track).collect(), key=lambda r: r.timestamp)
    assert [r.latitude for r in got] == [40.0, None, 40.01]
    assert [r.speed for r in got] == [3.0] * 3


# ---- W8


def walk_doubled(series, tol=0.05):
    def near(a, b):
        return abs(a - b) <= tol * max(abs(b), 1e-9)

    out, last = [], None
    for m, s in series:
        pm, ps = last or (None, None)
        if pm is not None and near(m - pm, pm):
            m /= 2
        if ps is not None and s is not None and near(s, 2 * ps):
            s /= 2
        bad = m < 0 or (pm is not None and m < pm * (1 - tol)) or (s is not None and not 0 <= s <= 1)
        out.append(None if bad else (m, s))
        last = last if bad else (m, s)
    return out


def test_doubled_readings_equal_sequential_walk(spark):
    rng = random.Random(11)
    rows, expected, n = [], {}, 0
    for veh in range(25):
        t, m = START, 100.0
        series = []
        for _ in range(100):
            t += timedelta(minutes=rng.choice([0, 90, 300]))
            m += rng.random() * 10
            shown = m * 2 if rng.random() < 0.05 else (m / 3 if rng.random() < 0.03 else m)
            soc = rng.choice([None, 0.3, 0.31, 0.6, 0.9, 1.3 if rng.random() < 0.1 else 0.5])
            shown = None if rng.random() < 0.05 else shown
            n += 1
            rows.append((veh, t, n, shown, soc))
            if shown is not None:
                series.append((n, shown, soc))
        for (i, _, _), result in zip(series, walk_doubled([x[1:] for x in series])):
            expected[i] = result
    tel = frame(spark, rows, "veh_id long, timestamp timestamp_ntz, row_no long, mileage double, soc double")
    got = ordered_fold.repair_doubled(tel).collect()
    assert {r.row_no: (r.mileage, r.soc) if r.kept else None for r in got} == expected


# ---- W4, W11, W13


def test_service_interval_ignores_falls(spark):
    rows = [(1, 7, date(2024, 1, d), odo) for d, odo in ((1, 100), (5, 300), (9, 250), (12, 450))]
    rows += [(2, 7, date(2024, 1, 12), 500), (3, 8, date(2024, 1, 1), 10)]
    events = frame(spark, rows, "id int, veh_id int, date date, enter_odo int")
    got = {r.veh_id: (r.avg_miles, r.steps) for r in sequences.service_interval(events).collect()}
    assert got == {7: (pytest.approx((200 + 200 + 50) / 3), 3)}


def test_single_point_is_no_track(spark):
    rows = [(1, START, 1.0, 2.0)] + [(2, START + timedelta(hours=h), 1.0, 2.0) for h in (0, 30)]
    points = frame(spark, rows, "veh_id int, timestamp timestamp_ntz, latitude double, longitude double")
    got = sequences.trajectories(points, ["veh_id"]).collect()
    assert sorted((r.veh_id, r.seq) for r in got) == [(2, 1), (2, 2)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_weekday_hours_equal_minute_count_on_clock_change_days(spark, zone):
    from zoneinfo import ZoneInfo

    sessions = [
        (datetime(2026, 3, 8, 5, 17), datetime(2026, 3, 8, 9, 43)),
        (datetime(2026, 11, 1, 3, 5), datetime(2026, 11, 1, 8, 59)),
        (datetime(2026, 5, 1, 3, 0), datetime(2026, 5, 1, 4, 0)),
        (datetime(2026, 5, 1, 4, 0), datetime(2026, 5, 1, 4, 0)),
        (datetime(2026, 5, 1, 4, 0), None),
    ]
    cells = {}
    for s, e in sessions:
        while e and s < e:
            local = s.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("America/New_York"))
            cells[local.weekday(), local.hour] = cells.get((local.weekday(), local.hour), 0) + 1
            s += timedelta(minutes=1)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sequences.weekday_hour_minutes(frame(spark, sessions, "s timestamp_ntz, e timestamp_ntz"), "s", "e").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(got) == 168
    assert {(r.weekday, r.hour): r.minutes for r in got if r.minutes} == cells


def test_empty_input_gives_empty_results(spark):
    tel = frame(spark, [], "veh_id long, timestamp timestamp_ntz, mileage double, soc double, speed double, latitude double, longitude double, row_no long")
    assert sequences.vehicle_day(tel).isEmpty()
    assert ordered_fold.flag_gps_jumps(tel).isEmpty()
    assert ordered_fold.repair_doubled(tel).isEmpty()
    assert sequences.weekday_hour_minutes(tel.selectExpr("timestamp as s", "timestamp as e"), "s", "e").count() == 168


def test_rows_without_key_or_time_stay_in_monotonic_mileage(spark):
    rows = [(1, START, 5.0), (None, START, 6.0), (1, None, 7.0)]
    got = sequences.monotonic_mileage(spark.createDataFrame(rows, "veh_id int, timestamp timestamp_ntz, mileage_raw double")).collect()
    assert sorted(((r.veh_id, r.timestamp, r.mileage) for r in got), key=str) == sorted([(1, START, 5.0), (None, START, None), (1, None, None)], key=str)


def test_trackless_points_are_given_apart(spark):
    rows = [(1, START, 1.0), (1, START + timedelta(minutes=1), 2.0), (None, START, 3.0), (None, START, 4.0)]
    points = spark.createDataFrame([(v, t, x, x) for v, t, x in rows], "veh_id int, timestamp timestamp_ntz, latitude double, longitude double")
    assert sequences.trajectories(points, ["veh_id"]).count() == 2
    assert sequences.trackless(points, ["veh_id"]).count() == 2


def test_weekday_hours_hold_sums_beyond_the_interval_range(spark):
    rows = spark.range(3_000_000).selectExpr("timestamp_ntz'2024-01-01 00:00:00' s", "timestamp_ntz'2024-01-01 01:00:00' e")
    many = sequences.weekday_hour_minutes(rows, "s", "e", "UTC")
    assert {r.minutes for r in many.where("minutes > 0").collect()} == {180_000_000.0}


def test_trips_of_one_day_are_ordered_across_partitions(spark):
    from amperoute.plans import loads

    row = "vin string, date date, trip_num int, init_odo double, final_odo double, tot_dist double, tot_dura double, idle_time double, init_soc double, final_soc double, tot_energy double, row_no long"
    day = START.date()
    trips = [("v", day, 1, 100.0, 111.0, 1.0, 1.0, 0.0, 0.9, 0.8, 1.0, 1200 << 33), ("v", day, 2, 200.0, 222.0, 1.0, 1.0, 0.0, 0.7, 0.6, 1.0, 0)]
    trips += [("w", day, None, 5.0, 6.0, 1.0, 1.0, 0.0, 0.9, 0.8, 1.0, 0), ("w", day, 3_000_000, 1.0, 2.0, 1.0, 1.0, 0.0, 0.7, 0.6, 1.0, 9)]
    days = loads.trips_to_days(spark.createDataFrame(trips, row), ["vin", "date"], loads.trip_order())
    got = {r.vin: (r.init_odo, r.final_odo) for r in days.collect()}
    assert got == {"v": (100.0, 222.0), "w": (1.0, 6.0)}


def test_weekday_hours_of_a_century_need_few_rows(spark):
    from zoneinfo import ZoneInfo

    long = (datetime(1970, 1, 1, 5, 30), datetime(2070, 1, 1, 5, 10))
    rows = [long, (datetime(1969, 12, 31, 23, 0), datetime(1970, 1, 1, 0, 0)), (datetime(2030, 5, 1, 3, 20), datetime(2030, 5, 1, 6, 40))]
    got = sequences.weekday_hour_minutes(frame(spark, rows, "s timestamp_ntz, e timestamp_ntz"), "s", "e")
    cells = {}
    zone, utc = ZoneInfo("America/New_York"), ZoneInfo("UTC")
    for s, e in rows:
        at = s
        while at < e:
            end = min(e, at.replace(minute=0) + timedelta(hours=1))
            local = at.replace(tzinfo=utc).astimezone(zone)
            cells[local.weekday(), local.hour] = cells.get((local.weekday(), local.hour), 0) + (end - at).seconds / 60
            at = end
    assert {(r.weekday, r.hour): r.minutes for r in got.collect()} == cells


def test_dense_slots_over_many_ranges(spark):
    names = [f"n{i:06d}" for i in random.Random(2).sample(range(1_000_000), 3000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sequences.dense_slot(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), "name", 24).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {r.name: r.slot for r in got} == {n: i % 24 for i, n in enumerate(sorted(names))}


def test_asof_reads_each_side_once_and_bounds_the_stored_one(spark, tmp_path):
    rows = [(v, START + timedelta(hours=h), float(100 * v + h)) for v in range(40) for h in range(30)]
    schema = "veh_id int, timestamp timestamp_ntz, mileage double"
    frame(spark, rows, schema).write.parquet(f"{tmp_path}/stored")
    frame(spark, [(v, START + timedelta(hours=v % 7), 0.0) for v in range(0, 50, 2)], schema).drop("mileage").write.parquet(f"{tmp_path}/batch")
    found = asof_anchor(spark.read.parquet(f"{tmp_path}/batch"), spark.read.parquet(f"{tmp_path}/stored"))
    got = {r.veh_id: r.anchor for r in found.collect()}
    assert got == {v: None if v >= 40 or v % 7 == 0 else 100.0 * v + v % 7 - 1 for v in range(0, 50, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "mileage" in line for line in plan.splitlines()) == 1
    assert "scalar-subquery" in plan and "Window" not in plan


@pytest.mark.parametrize("block_minutes", [30, 600])
def test_folds_chain_over_many_blocks(spark, block_minutes):
    """Clusters that span many blocks, moves never taken back, kept readings too high for all that follow, lasting doubles."""
    rng = random.Random(block_minutes)
    rows, flags, repairs, n = [], {}, {}, 0
    for veh in range(30):
        t, m, lat, away, factor, points, series = START, 50.0, 40.0, 0.0, 1, [], []
        for _ in range(150):
            t += timedelta(minutes=rng.choice([5, 20, 45, 300]))
            m += rng.random() * 3
            lat += rng.uniform(-0.01, 0.01) + (0.4 if rng.random() < 0.01 else 0)
            if rng.random() < 0.05:
                away = 0.0 if away else rng.choice([0.3, 1.0, -3.0, 40.0])
            if rng.random() < 0.03:
                factor = rng.choice([1, 1, 2, 2, 4, 1.2, 0.5])
            shown = m * factor * (30 if rng.random() < 0.004 else 1) * (-1 if rng.random() < 0.005 else 1)
            soc = rng.choice([None, 0.4, 0.41, 0.8, 0.82, 1.6, -0.1, 0.0])
            n += 1
            rows.append((veh, t, n, shown, soc, None if rng.random() < 0.01 else lat + away, -77.0))
            points.append(rows[-1][1:2] + rows[-1][5:])
            series.append((n, shown, soc))
        flags |= {(veh, p[0]): f for p, f in zip(points, walk_jumps(points))}
        repairs |= {i: result for (i, _, _), result in zip(series, walk_doubled([x[1:] for x in series]))}
    tel = frame(spark, rows, "veh_id long, timestamp timestamp_ntz, row_no long, mileage double, soc double, latitude double, longitude double")
    got = ordered_fold.flag_gps_jumps(tel, block_minutes=block_minutes).collect()
    assert {(r.veh_id, r.timestamp): r.gps_outlier for r in got} == flags and len(got) == len(rows)
    got = ordered_fold.repair_doubled(tel, block_minutes=block_minutes).collect()
    assert {r.row_no: (r.mileage, r.soc) if r.kept else None for r in got} == repairs
