"""Physical plans: pushdown, pruning, no Python in expression queries, hot keys reduced before shuffles."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from amperoute.operators import filters
from amperoute.registry import QUERIES
from amperoute.sources.views import VIEWS, Tables

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables not present")
FOLDED = {"w07_gps_jumps", "w08_doubled_readings", "q22_fleet_file", "q22_telematics_sheet", "dq6_repairs"}


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, str(FOLDER))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FOLDED))
def test_plan_has_no_python_and_no_cartesian_product(tables, name):
    text = plan(QUERIES[name](tables))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|CartesianProduct", text)
    joins = re.findall(r"BroadcastNestedLoopJoin", text)
    assert not joins


def test_instant_range_reaches_the_scan(tables):
    text = plan(filters.instants_between(tables.veh_tel.select("timestamp", "veh_id"), "timestamp", "2024-01-05", "2024-01-06"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in text and "LessThan(ts,2024-01-07" in text
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", text)


def test_unset_sql_parameters_fold_away(spark, tables):
    tables.register()
    sql = "select speed from veh_tel where (:fleet is null or veh_id = :fleet) and (:start is null or timestamp >= :start)"
    text = plan(spark.sql(sql, args={"fleet": None, "start": "2024-01-10"}))
    assert "user_id" not in text.split("FileScan")[1].split("ReadSchema")[1]
    assert spark.sql("select count(*) n from fleet f join vehicle v on v.fleet_id = f.id").first().n > 0
    assert {t.name for t in spark.catalog.listTables()} >= set(VIEWS)


def test_dedup_ranks_before_the_shuffle(tables):
    text = plan(QUERIES["w10_keep_best"](tables))
    assert re.search(r"row_number\(\), 1, Partial", text)


def test_facts_are_reduced_before_dimension_joins(tables):
    text = plan(QUERIES["q03_charging_summary"](tables))
    scan = text.index("orders.parquet")
    above = text[:scan]
    assert above.rindex("partial_sum") > above.rindex("Join [charger_id")


def test_vehicle_day_orders_rows_only_inside_slices(tables):
    text = plan(QUERIES["q01_vehicle_day"](tables))
    assert text.count("Exchange hashpartitioning") == 2
    assert "hashpartitioning(veh_id" in text and re.search(r"hashpartitioning\(veh_id#\d+L, date#\d+, slice", text)


def test_latest_days_uses_a_scalar_subquery(tables):
    text = plan(filters.latest_days(tables.refuel_inf.withColumn("date", F.to_date("connect_time"))))
    assert "Subquery" in text and "Join" not in text.split("Subquery")[0]
