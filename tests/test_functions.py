"""Scalar parsers, clocks and labels on edge values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from amperoute.functions import geo, labels, measures, parse
from amperoute.functions.zones import local_to_utc, localize_in_row_order


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (parse.number, {"1.5": 1.5, " -2 ": -2.0, "1e3": 1000.0, "1d": None, "nan": None, "": None, "abc": None, None: None}),
        (parse.duration_minutes, {"01:30:30": 90.5, "25:02:03": 1502.05, "1 days 02:00:00": 1560.0, "0.5": 720.0, "12:30": None, "x": None}),
        (parse.boolean, {" Yes ": True, "T": True, "1": True, "no": False, "0": False, "maybe": None, "": None}),
        (parse.first_number, {"$1,250.50 (tow)": 1250.5, "none": None, "-3 USD, 4": -3.0, "": None, None: None}),
        (parse.cost_note, {"$1,250.50 (tow 2)": "tow 2", "none so far": "none so far", "(40)": None, " ": None}),
        (parse.category, {" repair: axle: x": "repair", ":x": None, "plain ": "plain", " ": None}),
        (parse.soc_from_percent_text, {"85%": 0.85, "85": 0.85, "n/a": None}),
        (parse.leading_code, {"T1 :sha256:9": "T1", "nan": None, "T2": "T2"}),
        (parse.vehicle_code, {" ab 1? ": "AB1", " ?": None, None: None}),
        (parse.datetime, {
            "2026-03-08 01:59:00": datetime(2026, 3, 8, 1, 59), "3/8/2026 14:05": datetime(2026, 3, 8, 14, 5),
            "3/8/2026 2:05 PM": datetime(2026, 3, 8, 14, 5), "3/8/2026 2:05:09 AM": datetime(2026, 3, 8, 2, 5, 9),
            "2026-03-08": datetime(2026, 3, 8), "13/45/2026": None, "": None,
        }),
        (parse.utc_datetime, {
            "2026-03-08T01:00:00Z": datetime(2026, 3, 8, 1), "2026-03-08 01:00:00-05:00": datetime(2026, 3, 8, 6),
            "2026-03-08 01:00:00": datetime(2026, 3, 8, 1),
        }),
        (lambda x: labels.labels_of_list(x, labels.CONNECTOR_TYPE), {"2, 3": "CCS connector, CHAdeMO connector", "9": "9", ",": "", None: ""}),
        (lambda x: labels.label(x, labels.CHARGER_TYPE), {"3": "DCFC", "2, 3": "2, 3", None: None}),
        (labels.text_or, {" ": "Unknown", None: "Unknown", "a ": "a "}),
        (labels.location_bucket, {None: "Unknown", " In-House": "In-house", "": "Outsourced"}),
    ],
)
def test_text(spark, function, cases):
    assert apply(spark, function, list(cases)) == [v if not isinstance(v, float) else pytest.approx(v) for v in cases.values()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (parse.soc_share, {85.0: 0.85, 0.5: 0.5, 1.0: 1.0}),
        (parse.soc_from_percent, {85.0: 0.85, 0.5: 0.005}),
        (parse.soc_share_exact, {33.0: 0.33, 1.0: 1.0}),
        (parse.soc_share_clamped, {130.0: 1.0, -0.5: 0.0, 1.0000005: 1.0, 55.5: 0.555, None: None}),
        (measures.half_even_int, {0.5: 0, 1.5: 2, 2.5: 2, -1.5: -2, None: None}),
        (measures.floor_at_zero, {-1.0: 0.0, 2.0: 2.0, None: None}),
        (lambda x: measures.average_power(F.lit(10.0), x), {30.0: 20.0, 0.0: None, None: None}),
        (lambda x: measures.energy_per_mile(x, F.lit(20.0)), {9.9: None, 10.0: 2.0, None: None}),
    ],
)
def test_numbers(spark, function, cases):
    assert apply(spark, function, list(cases), "double") == list(cases.values())


def test_problem_text(spark):
    rows = spark.createDataFrame(
        [(1, "a: b", "c"), (2, "a: b", None), (3, "a:", " c "), (4, "a", " c "), (5, None, ""), (6, "a: b", "")], "i int, c string, p string"
    )
    got = rows.select("i", parse.problem_with_detail(F.col("c"), F.col("p")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == ["b: c", "b", "c", "c", None, "b"]


def test_station_note_is_added_once(spark):
    note = parse.STATION_NOTE
    rows = spark.createDataFrame([(1, "C03", "x"), (2, "C03", f"x {note}"), (3, "C03", None), (4, "C1", "x")], "i int, c string, p string")
    got = rows.select("i", parse.with_station_note(F.col("c"), F.col("p")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [f"x {note}", f"x {note}", note, "x"]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_clock_changes(spark, zone):
    wall = [datetime(2026, 3, 8, 1, 59), datetime(2026, 3, 8, 2, 30), datetime(2026, 3, 8, 3, 0), datetime(2026, 11, 1, 0, 59),
            datetime(2026, 11, 1, 1, 30), datetime(2026, 11, 1, 2, 0)]
    rows = spark.createDataFrame([(w,) for w in wall], "w timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        out = local_to_utc(local_to_utc(rows, {"w": "shifted"}), {"w": "strict"}, gap="null").orderBy("w").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    seven = datetime(2026, 3, 8, 7)
    assert [r.shifted for r in out] == [datetime(2026, 3, 8, 6, 59), seven, seven, datetime(2026, 11, 1, 4, 59), None, datetime(2026, 11, 1, 7)]
    assert [r.strict for r in out][1:3] == [None, seven]


def test_repeated_hour_is_told_apart_by_row_order(spark):
    walls = [(1, "00:50"), (2, "01:10"), (3, "01:50"), (4, "01:05"), (5, "01:55"), (6, "02:10")]
    rows = [("a", i, datetime.fromisoformat(f"2026-11-01 {t}")) for i, t in walls]
    rows += [("b", 1, datetime(2026, 11, 1, 1, 10)), ("b", 2, datetime(2026, 11, 1, 1, 20))]
    frame = spark.createDataFrame(rows, "k string, i int, w timestamp_ntz")
    got = localize_in_row_order(frame, "w", "u", ["k"], ["i"]).orderBy("k", "i").collect()
    assert [r.u.strftime("%H:%M") if r.u else None for r in got] == ["04:50", "05:10", "05:50", "06:05", "06:55", "07:10", None, None]


def test_great_circle(spark):
    lit = F.lit
    row = spark.range(1).select(geo.haversine_miles(lit(40.0), lit(-77.0), lit(41.0), lit(-76.0)).alias("d")).first()
    assert row.d == pytest.approx(86.7986, abs=1e-3)
