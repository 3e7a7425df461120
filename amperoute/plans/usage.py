"""Daily usage queries Q7-Q10 and their options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import text_or
from ..functions.measures import energy_per_mile, round_to
from ..operators import mergeable as m
from ..operators.filters import dated, latest_days, where_set
from ..operators.joins import vehicles_with_fleet

TEXT_COLUMNS = ("fleet", "make", "model", "class", "fleet_vehicle_id")
# How a daily series combines its rows; any other metric is averaged.
METRIC_AGGREGATES = {
    "tot_dist": "sum",
    "tot_energy": "sum",
    "tot_soc_used": "mean",
    "idle_time": "sum",
    "peak_payload": "max",
    "init_soc": "mean",
    "final_soc": "mean",
    "tot_dura": "sum",
}


def vehicle_labels(vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    return vehicles_with_fleet(vehicle, fleet, "left").select(
        "veh_id", F.col("fleet_name").alias("fleet"), "make", "model", "class", "fleet_vehicle_id"
    )


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text_or(F.col(c)) for c in TEXT_COLUMNS if c in df.columns})


def measured(daily: DataFrame) -> DataFrame:
    """Dated rows, SOC use in percent, missing measures as null columns."""
    for c in ("peak_payload", "efficiency"):
        if c not in daily.columns:
            daily = daily.withColumn(c, F.lit(None).cast("double"))
    return dated(daily).withColumn("tot_soc_used", F.col("tot_soc_used") * 100)


def labelled(daily: DataFrame, vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    """J-2 row by row, for filters on labels and for export."""
    return _texts(measured(daily).join(vehicle_labels(vehicle, fleet), "veh_id", "left"))


def scoped(
    daily: DataFrame,
    vehicle: DataFrame,
    fleet: DataFrame,
    filters: Mapping[str, object] | None = None,
    start=None,
    end=None,
    recent: bool = False,
) -> DataFrame:
    """Rows under the page's filters; with none chosen and ``recent``, the last 30 days."""
    chosen = {k: v for k, v in (filters or {}).items() if v}
    if chosen:
        return where_set(labelled(daily, vehicle, fleet), chosen, start=start, end=end)
    rows = where_set(measured(daily), start=start, end=end)
    return latest_days(rows) if recent and not (start or end) else rows


def _efficiency() -> Column:
    return energy_per_mile(F.col("tot_dist"), F.col("tot_energy"), F.col("efficiency"))


def _positive(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name))


def _weighted_parts() -> dict[str, m.Part]:
    eff = _efficiency()
    return {
        "eff_num": m.total(eff * F.col("tot_dist")),
        "eff_den": m.total(F.when(eff.isNotNull(), F.col("tot_dist"))),
    }


def _fleet_metrics(rows: DataFrame, vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    parts = {
        "total_distance": m.total(F.col("tot_dist")),
        "daily_distance": m.mean(_positive("tot_dist")),
        "daily_energy": m.mean(_positive("tot_energy")),
        "daily_soc_used": m.mean(_positive("tot_soc_used")),
        "daily_driving_time": m.mean(_positive("tot_dura")),
        "daily_idle_time": m.mean(F.col("idle_time")),
        **_weighted_parts(),
    }
    reduced = m.reduce_by_key(rows, ["veh_id"], parts)
    named = _texts(reduced.join(vehicle_labels(vehicle, fleet).select("veh_id", "fleet"), "veh_id", "left"))
    return m.combine(named, ["fleet"], parts).select(
        "fleet",
        round_to(F.coalesce("total_distance", F.lit(0.0)), 2).alias("total_distance"),
        "daily_distance",
        "daily_energy",
        F.when(F.col("eff_den") > 0, F.col("eff_num") / F.col("eff_den")).alias("efficiency"),
        "daily_soc_used",
        "daily_driving_time",
        "daily_idle_time",
    )


def fleet_summary(rows: DataFrame, vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    """Q7."""
    out = _fleet_metrics(rows, vehicle, fleet)
    return out.select("fleet", *[round_to(F.col(c), 4).alias(c) for c in out.columns[1:]])


def headline(rows: DataFrame, vehicle: DataFrame, fleet: DataFrame) -> DataFrame:
    """Q8: total distance, and means over fleets where a fleet without a value counts as 0."""
    fleets = _fleet_metrics(rows, vehicle, fleet)

    def over_fleets(c: str) -> Column:
        return round_to(F.avg(F.coalesce(c, F.lit(0.0))), 2).alias(c)

    return fleets.agg(
        round_to(F.sum("total_distance"), 2).alias("total_distance"),
        *[over_fleets(c) for c in ("daily_distance", "daily_energy", "daily_driving_time", "daily_soc_used")],
    ).na.fill(0.0)


def daily_metric(rows: DataFrame, metric: str) -> DataFrame:
    """Q9: one metric per date, combined as the metric asks."""
    return daily_metrics(rows.where(F.col(metric).isNotNull()), [metric])


def daily_metrics(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Q9 for several metrics in one pass."""
    kinds = {"sum": F.sum, "mean": F.avg, "max": F.max}
    return rows.groupBy("date").agg(
        *[round_to(kinds[METRIC_AGGREGATES.get(c, "mean")](c), 4).alias(c) for c in metrics]
    )


def daily_efficiency(rows: DataFrame) -> DataFrame:
    """Q10: distance-weighted kWh per mile per date."""
    parts = _weighted_parts()
    out = m.reduce_by_key(rows, ["date"], parts)
    return out.where("eff_den > 0").select("date", round_to(F.col("eff_num") / F.col("eff_den"), 6).alias("efficiency"))


def status(daily: DataFrame) -> DataFrame:
    """Q-DQ5."""
    return dated(daily).agg(F.count("*").alias("n_rows"), F.max("date").alias("latest_date"))


def options(daily: DataFrame, vehicle: DataFrame, fleet: DataFrame, fleet_name: str | None = None) -> DataFrame:
    """Q20 for the usage page: distinct values per filter, cascading from the fleet."""
    seen = _texts(
        measured(daily).select("veh_id").distinct().join(vehicle_labels(vehicle, fleet), "veh_id", "left")
    )
    pairs = ", ".join(f"'{c}', {c}" for c in TEXT_COLUMNS)
    return (
        where_set(seen, {"fleet": fleet_name})
        .selectExpr(f"stack({len(TEXT_COLUMNS)}, {pairs}) as (option, value)")
        .distinct()
        .orderBy("option", "value")
    )
