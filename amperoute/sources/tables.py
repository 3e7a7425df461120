"""Warehouse tables: scans, seeds and writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import merge_into


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Projection reaches the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, column: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """S1 from a live database, read in parallel ranges of one numeric column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, **options)
        .load()
    )


def located(fleet: DataFrame) -> DataFrame:
    """Fleets that can be drawn on a map."""
    return fleet.where("latitude is not null and longitude is not null")


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    r"""Tab-separated rows, ``\N`` for null, t and f for booleans."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(raw).option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def flagged_areas(areas: DataFrame) -> DataFrame:
    """S9."""
    return areas.where("ejarea")


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """S10."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def upsert_table(
    source: DataFrame, path: str, out_path: str, keys: Sequence[str], *, policy: str = "overwrite",
    columns: Sequence[str] | None = None,
) -> dict[str, int]:
    """Write the merged table to a new folder; the action counts are observed during that write.

    The result is written apart, so a failed job never leaves a half-written target.
    """
    spark = source.sparkSession
    merged = merge_into(spark.read.parquet(path), source, keys, policy=policy, columns=columns)
    seen = Observation()
    actions = ("inserted", "updated", "unchanged", "kept")
    watched = merged.observe(seen, *[F.count_if(F.col("merge_action") == a).alias(a) for a in actions])
    watched.drop("merge_action").write.mode("errorifexists").parquet(out_path)
    return dict(seen.get)


def touched_rows(target: DataFrame, source: DataFrame, partition: str) -> DataFrame:
    """Stored rows of the partitions that ``source`` has rows in, the null partition included.

    The bounds reach the scan as partition filters, so partitions outside them are not read.
    """
    bounds = source.agg(F.min(partition).alias("low"), F.max(partition).alias("high"), F.max(F.col(partition).isNull()).alias("nulls"))
    low, high, nulls = (bounds.select(c).scalar() for c in ("low", "high", "nulls"))
    column = F.col(partition)
    inside = target.where(((column >= low) & (column <= high)) | (column.isNull() & nulls))
    touched = source.select(F.col(partition).alias("__touched")).distinct()
    return inside.join(touched, inside[partition].eqNullSafe(touched["__touched"]), "left_semi")


def upsert_partitions(
    source: DataFrame, path: str, keys: Sequence[str], *, partition: str = "date", policy: str = "overwrite",
    columns: Sequence[str] | None = None, staging: str | None = None,
) -> dict[str, int]:
    """S11 for a table partitioned by ``partition`` (one of the keys): only partitions the batch touches are rewritten.

    The merged partitions are written to ``staging`` (a new folder beside the table unless given) first and then take
    the place of the stored ones: the folder that is overwritten is not read by the job that overwrites it, and after a
    failure the staged rows are whole. Large partitions are split over tasks. Returns the counts per action.
    """
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    spark = source.sparkSession
    target = spark.read.parquet(path)
    merged = merge_into(touched_rows(target, source, partition), source, keys, policy=policy, columns=columns)
    seen = Observation()
    actions = ("inserted", "updated", "unchanged", "kept")
    watched = merged.observe(seen, *[F.count_if(F.col("merge_action") == a).alias(a) for a in actions])
    staging = staging or f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    watched.select(*target.columns).hint("rebalance", partition).write.parquet(staging)
    (
        spark.read.schema(target.schema).parquet(staging)
        .hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return dict(seen.get)
