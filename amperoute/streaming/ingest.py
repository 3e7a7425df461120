"""Continuous ingestion (K4): files arrive, each micro-batch merges into the stored table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import unique_source
from ..sources.tables import upsert_partitions


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, *, files_per_batch: int = 1000) -> DataFrame:
    """Arriving CSV files as text columns plus the file's stem."""
    rows = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return rows.withColumn("code", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1))


def merge_batch(path: str, keys: Sequence[str], *, partition: str, policy: str, order: Sequence[Column]) -> Callable:
    """A foreachBatch function: duplicates inside the batch are settled, then touched partitions are merged.

    Running a batch again after a failure gives the same table, as merges are idempotent.
    """

    def merge(batch: DataFrame, _epoch: int) -> None:
        unique = unique_source(batch, keys, *order)
        try:
            batch.sparkSession.read.parquet(path).schema  # noqa: B018
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            unique.hint("rebalance", partition).write.partitionBy(partition).parquet(path)
            return
        upsert_partitions(unique, path, keys, partition=partition, policy=policy)

    return merge


def merge_stream(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    checkpoint: str,
    *,
    order: Sequence[Column],
    partition: str = "date",
    policy: str = "overwrite",
) -> StreamingQuery:
    """Start merging everything available and stop; schedule it again for more.

    ``order`` ranks rows of one key inside a batch, first wins; make it unique.
    """
    step = merge_batch(path, keys, partition=partition, policy=policy, order=order)
    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
