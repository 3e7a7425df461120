"""The warehouse's tables as views over the benchmark tables.

Each view is a list of column expressions over one whole table, in SQL both Spark and the oracle engine
read. Key expressions divide, never filter: counts of vehicles and chargers grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MINUTE = "interval '1' minute"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "fleet": (
        "nation",
        [
            "n_nationkey as id",
            "n_name as fleet_name",
            "20 + 3 * n_nationkey as fleet_size",
            "case when n_nationkey % 6 = 1 then null else 2 + n_nationkey end as zev_tot",
            "case when n_nationkey % 5 = 4 then null else 10 + n_nationkey end as zev_grant",
            "case when n_nationkey % 8 = 5 then null else 1 + n_nationkey % 9 end as charger_grant",
            "concat(cast(100 + n_nationkey as string), ' Depot Road') as depot_adr",
            "concat('Vendor ', cast(n_regionkey as string)) as vendor_name",
            "case when n_nationkey % 7 = 6 then null else cast(39.5 + n_nationkey * 0.1 as double) end as latitude",
            "case when n_nationkey % 11 = 10 then null else cast(-80.0 + n_nationkey * 0.1 as double) end as longitude",
        ],
    ),
    "vehicle": (
        "customer",
        [
            "c_custkey as id",
            "c_nationkey as fleet_id",
            "c_name as fleet_vehicle_id",
            "case when c_custkey % 13 = 5 then null when c_custkey % 13 = 6 then ' ' else c_mktsegment end as make",
            "concat('M', cast(c_custkey % 4 as string)) as model",
            "2020 + c_custkey % 6 as year",
            "case when c_custkey % 10 = 3 then null else 2 + c_custkey % 7 end as class",
        ],
    ),
    "charger": (
        "supplier",
        [
            "s_suppkey as id",
            "s_nationkey as fleet_id",
            "concat('CH', cast(cast(floor(s_suppkey / 4) as bigint) as string), '-', cast(s_suppkey % 4 as string)) as charger",
            "case when s_suppkey % 9 = 0 then '2, 3' when s_suppkey % 9 = 1 then null "
            "else cast(1 + s_suppkey % 5 as string) end as charger_type",
            "case when s_suppkey % 7 = 0 then '2, 3' when s_suppkey % 7 = 1 then null "
            "else cast(1 + s_suppkey % 8 as string) end as connector_type",
        ],
    ),
    "veh_tel": (
        "events",
        [
            "event_id as id",
            "cast(floor(user_id / 8) as bigint) as veh_id",
            "ts as `timestamp`",
            "case when event_id % 97 = 0 then null when event_type in ('click', 'view') then value else 0.0 end as speed",
            "case when event_id % 89 = 0 then null else cast((event_id % 4000) * 0.25 as double) end as mileage",
            "case when event_id % 53 = 0 then null else cast((100 - event_id % 101) / 100.0 as double) end as soc",
            "case when event_id % 211 = 0 or floor(event_id / 400) % 25 = 7 then cast(41.5 + (event_id % 17) * 0.0031 as double) "
            "else cast(40.0 + (event_id % 13) * 0.0041 as double) end as latitude",
            "case when event_id % 307 = 0 then null else cast(-77.0 + (event_id % 7) * 0.0037 as double) end as longitude",
            "event_type as details",
        ],
    ),
    "refuel_inf": (
        "orders",
        [
            "o_orderkey as id",
            "cast(floor(o_custkey / 14) as bigint) as charger_id",
            "o_custkey as veh_id",
            f"case when o_orderkey % 11 = 0 then null else o_orderdate + ((o_orderkey * 37) % 1440) * {_MINUTE} end as refuel_start",
            f"case when o_orderkey % 13 = 0 then null else o_orderdate + ((o_orderkey * 37) % 1440 + 20 + o_orderkey % 300) * {_MINUTE} end as refuel_end",
            f"o_orderdate + ((o_orderkey * 37) % 1440 - 5) * {_MINUTE} as connect_time",
            f"o_orderdate + ((o_orderkey * 37) % 1440 + 400) * {_MINUTE} as disconnect_time",
            "case when o_orderkey % 17 = 0 then null else o_totalprice / 1000 end as tot_energy",
            "case when o_orderkey % 3 = 0 then null else cast(20 + o_orderkey % 300 as double) end as tot_ref_dura",
            "o_totalprice / 5000 as avg_power",
            "cast((o_orderkey % 50) / 100.0 as double) as start_soc",
            "cast((50 + o_orderkey % 50) / 100.0 as double) as end_soc",
        ],
    ),
    "veh_trip": (
        "lineitem",
        [
            "cast(floor(l_partkey / 200) as bigint) as veh_id",
            "cast(l_shipdate as date) as `date`",
            "case when l_orderkey % 31 = 0 then null else l_linenumber end as trip_num",
            "case when l_orderkey % 7 = 0 then null else l_extendedprice end as init_odo",
            "case when l_orderkey % 5 = 0 then null else l_extendedprice + l_quantity end as final_odo",
            "l_quantity as tot_dist",
            "l_quantity / 30 as tot_dura",
            "l_discount as idle_time",
            "l_tax * 10 as init_soc",
            "l_discount * 5 as final_soc",
            "l_discount as soc_used",
            "case when l_orderkey % 9 = 0 then 0.0 else l_quantity * 2 end as tot_energy",
            "l_orderkey as id",
            "l_returnflag as report",
            # the row's place as one number: trip (missing last), order, then what tells the rows of an order apart, in hundredths
            "cast(case when l_orderkey % 31 = 0 then 10 else l_linenumber end as decimal(38,0)) * cast(10000000000000000000000000000000 as decimal(38,0)) "
            "+ cast(l_orderkey as decimal(38,0)) * cast(1000000000000000000 as decimal(38,0)) + cast(cast(round(l_quantity) as bigint) * 1000000000000000 "
            "+ cast(round(l_discount * 100) as bigint) * 1000000000000 + cast(round(l_tax * 100) as bigint) * 1000000000 "
            "+ cast(round(l_extendedprice * 100) as bigint) as decimal(38,0)) as place",
        ],
    ),
    "maintenance": (
        "orders",
        [
            "o_orderkey as id",
            "case when o_orderkey % 41 = 0 then null else cast(o_orderdate as date) end as `date`",
            "case when o_orderkey % 3 = 0 then null else o_custkey end as veh_id",
            "case when o_orderkey % 6 = 0 then cast(floor(o_custkey / 14) as bigint) else null end as charger_id",
            "case when o_orderkey % 3 = 0 then 2 else 1 end as maint_ob",
            "case when o_orderkey % 211 = 0 then 'rare-a' when o_orderkey % 223 = 0 then 'rare-b' "
            "when o_orderkey % 19 = 0 then null else o_orderpriority end as maint_categ",
            "case when o_orderkey % 7 = 0 then null else cast(floor(o_totalprice) as bigint) end as enter_odo",
            "case when o_orderkey % 5 = 0 then null else o_totalprice / 100 end as parts_cost",
            "o_totalprice / 200 as labor_cost",
            "cast(10 as double) as add_cost",
            "case o_orderstatus when 'F' then true when 'O' then false else null end as warranty",
            "case o_orderpriority when '1-URGENT' then 'In-house' when '5-LOW' then null else 'vendor' end as maint_loc",
            f"o_orderdate + ((o_orderkey * 7) % 1440) * {_MINUTE} as enter_shop",
            f"case when o_orderkey % 10 = 0 then null else o_orderdate + ((o_orderkey * 7) % 1440 + 300) * {_MINUTE} end as exit_shop",
        ],
    ),
}


class Tables:
    """Base tables by name and domain views by attribute, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def register(self) -> None:
        """All views by name, for queries written in SQL."""
        for name in VIEWS:
            getattr(self, name).createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        table, columns = VIEWS[name]
        return self.base(table).selectExpr(*columns)


def view_sql(name: str) -> str:
    """The same view as a query text for the oracle engine."""
    table, columns = VIEWS[name]
    return f"select {', '.join(columns)} from {table}".replace("`", '"')
