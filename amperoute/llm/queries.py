"""The registered queries of this folder: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, extraction, hard_negatives, language_model, near_duplicates, neighbours, packing, quality, secrets, sharding, token_count, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark, folder):
    counted = token_count.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"))
    return counted.select("row.doc_id", "n_words", "n_tokens")


@query
def op2_nearest_neighbours(spark, folder):
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_hierarchical_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op4_language_model(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language_model.score(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("row.doc_id", "*").drop("row")


@query
def op5_near_duplicates(spark, folder):
    return near_duplicates.link(table(spark, folder, "documents"))


@query
def op6_main_text(spark, folder):
    found = extraction.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


@query
def op7_extendible_shards(spark, folder):
    return sharding.shards(table(spark, folder, "documents"))


@query
def op8_quality_rules(spark, folder):
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality.verdicts(table(spark, folder, "documents"), trusted)


@query
def op9_secret_scans(spark, folder):
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op10_byte_bpe(spark, folder):
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n_tokens = F.when(F.col("ids") == "", F.lit(0)).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1)
    return done.select("row.doc_id", n_tokens.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults at fixed rows: dropped, emptied, without ends of sentences, repeated, of the wrong role."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(told("role"))
    kept = rows.withColumn("fault", fault).where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("copy", "fault")


@query
def op11_conversation_repair(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repair.repair(damaged(rows)).withColumnRenamed("conv_id", "at")
    every = rows.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("at")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.select("conv_id", *[F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in repaired.columns if c != "at"])


@query
def op12_hard_negatives(spark, folder):
    rows = table(spark, folder, "embeddings")
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", wrong))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives.mine(sound.select("vec_id", label.alias("label"), whole.alias("x")), F.col("id") % 100 == 0)


@query
def op13_toxicity(spark, folder):
    scored = toxicity.score(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
