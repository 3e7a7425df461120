"""Corpus cleaning in four stages, each one written as Parquet and read again by the next.

Quality rules drop documents, near duplicates keep one document of each group, secret scans mask what they find, and
packing cuts the texts that are left into training sequences. A stage works on everything its predecessor kept; all but
the last return the columns of ``documents``. Null texts and ids, empty tables, repeated rows and extra columns are
handled as the operators' modules state; of rows that agree in id, text and all else, one stays after the second stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperoute.llm import near_duplicates, packing, quality, secrets
from amperoute.llm.queries import vocabulary
from amperoute.session import ensure_checkpoint_dir

# Words that packing remembers per generation: few, as other stages run beside what its workers still hold.
CACHED_WORDS = 120_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.kept_rows(docs, trusted)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. Texts without words all stay."""
    return near_duplicates.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each stretch that holds a secret replaced by a mark; ``n_chars`` follows the text."""
    found = secrets.scan(docs)
    text = F.when(F.size("spans") > 0, secrets.masked(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))
    masked = found.withColumn("masked", text)
    values = {"text": F.col("masked"), "n_chars": F.coalesce(F.length("masked").cast("long"), F.col("row.n_chars"))}
    return masked.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with a checksum of their ids."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), cached_words=CACHED_WORDS)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("secret_scans", secret_scans),
    ("packing", pack_sequences),
]
# Hashed n-grams, sketches and subword ids have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between them the rows are written to the folder the executors share."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}_{name}"
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
    return rows
