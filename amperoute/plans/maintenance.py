"""Maintenance queries Q11-Q14 and the asset options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import location_bucket, warranty_bucket
from ..functions.measures import round_to, total_cost
from ..operators import mergeable as m
from ..operators.filters import assets, latest_days, where_set
from ..operators.joins import with_owner_fleet
from ..operators.sequences import service_interval

NO_FLEET = "Unspecified"


def measured(events: DataFrame) -> DataFrame:
    """Events with total cost and display buckets."""
    return events.withColumns(
        {
            "total_cost": total_cost(F.col("parts_cost"), F.col("labor_cost"), F.col("add_cost")),
            "location": location_bucket(F.col("maint_loc")),
            "warranty_covered": warranty_bucket(F.col("warranty")),
            "category": F.coalesce("maint_categ", F.lit(NO_FLEET)),
        }
    )


def scoped(
    events: DataFrame,
    vehicle: DataFrame,
    charger: DataFrame,
    fleet: DataFrame,
    *,
    fleets=None,
    asset_type=None,
    asset_ids=None,
    start=None,
    end=None,
    recent: bool = False,
) -> DataFrame:
    """Q14: filters first; the 30-day scope is taken of what the asset filter leaves."""
    rows = measured(events)
    if fleets:
        rows = where_set(with_owner_fleet(rows, vehicle, charger, fleet), {"fleet_name": fleets}).drop(
            "fleet_id", "fleet_name", "vehicle_label", "charger_label"
        )
    rows = where_set(assets(rows, asset_type, asset_ids), start=start, end=end)
    if recent and not any([fleets, asset_ids, start, end]):
        rows = latest_days(rows)
    return rows


def kpis(events: DataFrame) -> DataFrame:
    """Q11: counts, mean total cost, mean of the vehicles' service intervals."""
    miles = service_interval(events).agg(F.avg("avg_miles"))
    return (
        measured(events)
        .agg(
            F.count("*").alias("events"),
            F.count("veh_id").alias("vehicle_events"),
            F.count("charger_id").alias("charger_events"),
            round_to(F.avg("total_cost"), 2).alias("avg_total_cost"),
        )
        .select("*", round_to(miles.scalar(), 2).alias("avg_miles_between_services"))
    )


def fleet_table(rows: DataFrame, vehicle: DataFrame, charger: DataFrame, fleet: DataFrame, asset_type=None) -> DataFrame:
    """Q12: one Vehicle and one Charger row per fleet, also when empty; costs over rows that have all three."""
    full = F.col("total_cost").isNotNull()
    parts = {
        "events": m.count(),
        "total_cost": m.total(F.col("total_cost")),
        "avg_total_cost": m.mean(F.col("total_cost")),
        "avg_parts_cost": m.mean(F.when(full, F.col("parts_cost"))),
        "avg_labor_cost": m.mean(F.when(full, F.col("labor_cost"))),
        "avg_added_cost": m.mean(F.when(full, F.col("add_cost"))),
    }
    owners = ["veh_id", "charger_id", (F.col("maint_ob") == 2).alias("station")]
    reduced = with_owner_fleet(m.reduce_by_key(rows, owners, parts), vehicle, charger, fleet)
    per_asset = reduced.withColumn("asset_type", F.explode(F.array(F.lit("Vehicle"), F.lit("Charger"))))
    is_vehicle = F.col("veh_id").isNotNull()
    is_charger = F.col("charger_id").isNotNull() | F.coalesce("station", F.lit(False))
    mine = F.when(F.col("asset_type") == "Vehicle", is_vehicle).otherwise(is_charger)
    columns = [c.name for c in m.reduce_by_key(rows, ["veh_id"], parts).schema.fields[1:]]
    per_asset = per_asset.withColumns({c: F.when(mine, F.col(c)) for c in columns})
    table = m.combine(per_asset, ["fleet_name", "asset_type"], parts)

    owned = with_owner_fleet(rows.where("veh_id is not null and enter_odo is not null"), vehicle, charger, fleet)
    miles = (
        service_interval(owned, extra=["fleet_name"])
        .groupBy(F.col("fleet_name").alias("of_fleet"))
        .agg(F.avg("avg_miles").alias("miles"))
        .withColumn("of_asset", F.lit("Vehicle"))
    )
    joined = table.join(
        miles,
        table["fleet_name"].eqNullSafe(miles["of_fleet"]) & (table["asset_type"] == miles["of_asset"]),
        "left",
    )
    if asset_type:
        joined = joined.where(F.col("asset_type") == asset_type.capitalize())
    return (
        joined.select(
            F.coalesce("fleet_name", F.lit(NO_FLEET)).alias("fleet"),
            "asset_type",
            "events",
            *[round_to(F.col(c), 2).alias(c) for c in list(parts)[1:]],
            round_to(F.col("miles"), 2).alias("avg_miles_between_services"),
        )
        .orderBy(F.asc_nulls_last("fleet"), F.col("asset_type").desc())
    )


def fold_small(counts: DataFrame, label: str, count: str, threshold: float = 0.01) -> DataFrame:
    """Labels below the share threshold add up to Other."""
    whole = counts.agg(F.sum(count)).scalar()
    small = F.try_divide(F.col(count).cast("double"), whole) < threshold
    folded = F.when(F.coalesce(small, F.lit(False)), F.lit("Other")).otherwise(F.col(label))
    return counts.groupBy(folded.alias(label)).agg(F.sum(count).alias(count))


def composition(rows: DataFrame, by: str) -> DataFrame:
    """Q13 for 'category' (small ones folded), 'warranty_covered' or 'location'."""
    counts = rows.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n"))
    return fold_small(counts, "label", "n") if by == "category" else counts


def asset_options(events: DataFrame, vehicle: DataFrame, charger: DataFrame, fleet: DataFrame, fleets=None) -> DataFrame:
    """Q20 for the maintenance page: assets with events and their labels."""
    owners = where_set(
        with_owner_fleet(events.select("veh_id", "charger_id").distinct(), vehicle, charger, fleet),
        {"fleet_name": fleets},
    )
    return (
        owners.selectExpr(
            "stack(2, 'vehicle', veh_id, vehicle_label, 'charger', charger_id, charger_label) as (asset_type, id, label)"
        )
        .where("id is not null")
        .select("asset_type", F.coalesce("label", F.col("id").cast("string")).alias("label"), "id")
        .distinct()
    )
