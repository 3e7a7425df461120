"""Data-health queries Q-DQ1..Q-DQ7."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import mergeable as m
from ..operators.filters import where_set
from ..operators.joins import chargers_with_fleet, orphans, vehicles_with_fleet, with_owner_fleet

NO_FLEET = "Unspecified"


def unmapped_codes(facts: DataFrame, code: str, dim: DataFrame, dim_code: str) -> DataFrame:
    """Q-DQ1: codes no dimension row has, with their row counts."""
    return orphans(facts.where(F.col(code).isNotNull()), code, dim, dim_code)


def orphan_counts(facts: Mapping[str, tuple[DataFrame, str, DataFrame]]) -> DataFrame:
    """Q-DQ2: per fact and key, rows without a dimension row (null keys count)."""
    out = None
    for name, (fact, key, dim) in facts.items():
        one = orphans(fact, key, dim).agg(
            F.lit(name).alias("fact"), F.lit(key).alias("key"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphans")
        )
        out = one if out is None else out.unionByName(one)
    return out


def _per_fleet(facts: DataFrame, dim: DataFrame, key: str, parts: Mapping[str, m.Part], fleets) -> DataFrame:
    reduced = m.reduce_by_key(facts, [key], parts)
    return m.combine(reduced.join(where_set(dim.select(key, "fleet_name"), {"fleet_name": fleets}), key), ["fleet_name"], parts)


def _maintenance_per_fleet(events, vehicle, charger, fleet, parts, fleets) -> DataFrame:
    reduced = m.reduce_by_key(events, ["veh_id", "charger_id"], parts)
    named = with_owner_fleet(reduced, vehicle, charger, fleet).withColumn(
        "fleet_name", F.coalesce("fleet_name", F.lit(NO_FLEET))
    )
    return m.combine(where_set(named, {"fleet_name": fleets}), ["fleet_name"], parts)


def per_fleet(
    tel: DataFrame,
    sessions: DataFrame,
    daily: DataFrame,
    events: DataFrame,
    vehicle: DataFrame,
    charger: DataFrame,
    fleet: DataFrame,
    fleets: Sequence[str] | None = None,
) -> DataFrame:
    """Q-DQ3 and Q-DQ4: newest date and row count per fact and fleet."""
    cars = vehicles_with_fleet(vehicle, fleet)
    plugs = chargers_with_fleet(charger, fleet)

    def parts(moment: Column) -> dict[str, m.Part]:
        return {"latest": m.largest(F.to_date(moment)), "n_points": m.count()}

    plugged = F.coalesce("connect_time", "refuel_end", "refuel_start")
    frames = {
        "telematics": _per_fleet(tel, cars, "veh_id", parts(F.col("timestamp")), fleets),
        "sessions": _per_fleet(sessions, plugs, "charger_id", parts(plugged), fleets),
        "daily": _per_fleet(daily, cars, "veh_id", parts(F.col("date")), fleets),
        "maintenance": _maintenance_per_fleet(events, vehicle, charger, fleet, parts(F.col("exit_shop")), fleets),
    }
    out = None
    for name, frame in frames.items():
        one = frame.select(F.lit(name).alias("fact"), "fleet_name", F.col("latest").alias("latest_date"), "n_points")
        out = one if out is None else out.unionByName(one)
    return out


def rejections(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Q-DQ6, A20: rows read and rows per violated rule, in one pass."""
    return df.agg(F.count("*").alias("rows_read"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


def duplicates(df: DataFrame, keys: Sequence[str], out: str = "duplicates_removed") -> DataFrame:
    """Rows a keep-one-per-key step removes."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(out))


def repairs(repaired: DataFrame) -> DataFrame:
    """Q-DQ6 for doubled readings: corrected and dropped rows."""
    return repaired.agg(
        F.count_if("mileage_fixed").alias("mileage_fixed"),
        F.count_if("soc_fixed").alias("soc_fixed"),
        F.count_if(~F.col("kept")).alias("dropped"),
    )


def duplicate_codes(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q-DQ7: (fleet, code) pairs that occur more than once."""
    return dim.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
