"""Sharding by extendible hashing: the directory is indexed by hash-prefix bits, and only buckets over the byte
limit are split on further bits until every shard fits.

Rows are hashed by id and text. Rows that agree in both cannot be told apart by any bit: they are kept as one entry
with a count, and where a full-depth bucket is still too large its copies are dealt out in pages by their number.

Defined results: a null id or text hashes as such (size 0 for a null text); an empty table gives no shards; one
row above the limit becomes a shard of its own, marked ``oversize``. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Production limit of one shard.
LIMIT_BYTES = 8 << 20
# Bits of the hash, and bits by which an oversized bucket's histogram is refined per round.
BITS = 60
ROUND_BITS = 10


def entries(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, hash, n_bytes, copies): one row per distinct (id, text); the hash is the first 60 bits of an MD5."""
    body = F.col(f"`{text}`")
    mixed = F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(body, F.lit("")), F.when(body.isNull(), F.lit("-")).otherwise(F.lit("+")))
    digest = F.conv(F.substring(F.md5(mixed.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), digest.alias("hash"), size.alias("n_bytes"))
    return rows.groupBy("doc_id", "hash", "n_bytes").agg(F.count("*").alias("copies"))


def directory(sizes: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(prefix, depth, shard_bytes): the leaves. Every bucket above the limit is split, no other is.

    Each round makes one aggregate: bytes per prefix, some bits deeper, of the oversized buckets only, and reads the
    bytes of all levels between off it. A leaf is the highest level that fits below a parent that does not.
    """
    ensure_checkpoint_dir(sizes.sparkSession)
    whole = sizes.agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("shard_bytes"), F.count("*").alias("n"))
    whole = whole.where("n > 0").select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), "shard_bytes").checkpoint()
    leaves, open_, depth = whole.where(F.col("shard_bytes") <= limit), whole.where(F.col("shard_bytes") > limit), 0
    while not open_.isEmpty() and depth < BITS:
        deeper = min(depth + ROUND_BITS, BITS)
        at = lambda bits: F.shiftright("hash", BITS - bits)  # noqa: B023,E731
        inside = sizes if depth == 0 else sizes.withColumn("top", at(depth)).join(open_.select(F.col("prefix").alias("top")), "top", "left_semi")
        lowest = inside.groupBy(at(deeper).alias("low")).agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("bytes"))
        levels = lowest.select(F.explode(F.sequence(F.lit(depth + 1), F.lit(deeper))).alias("depth"), "low", "bytes")
        up = F.expr(f"shiftright(low, {deeper} - depth)")
        nodes = levels.groupBy(up.alias("prefix"), "depth").agg(F.sum("bytes").alias("shard_bytes"))
        parents = nodes.where(F.col("shard_bytes") > limit).select(F.col("prefix").alias("up"), F.col("depth").alias("above"))
        parents = parents.union(open_.select("prefix", "depth"))
        reached = nodes.withColumn("up", F.shiftright("prefix", 1)).withColumn("above", F.col("depth") - 1)
        reached = reached.join(parents, ["up", "above"], "left_semi").select("prefix", "depth", "shard_bytes").checkpoint()
        fits = F.col("shard_bytes") <= limit
        leaves = leaves.union(reached.where(fits))
        open_, depth = reached.where(~fits & (F.col("depth") == deeper)), deeper
    return leaves.union(open_)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversize) for every row.

    ``shard`` is the bit prefix of the leaf, with ``.page`` appended where a bucket of full depth was dealt into pages.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = entries(docs, text, key).checkpoint()
    leaves = directory(sizes, limit)
    # A row meets its leaf at the leaf's own depth: levels with no leaf are not tried.
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    tried = sizes.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else sizes.withColumn("depth", F.lit(0))
    placed = tried.withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - depth)")).join(leaves, ["prefix", "depth"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    paged = F.col("shard_bytes") > limit
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    rows = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    page = F.when(paged & (F.col("depth") == BITS), F.floor((F.col("copy") - 1) / per_page))
    in_page = F.least(per_page, F.col("copies") - page * per_page) * F.col("n_bytes")
    return rows.select(
        "doc_id", "n_bytes",
        F.concat(bits, F.coalesce(F.concat(F.lit("."), page.cast("string")), F.lit(""))).alias("shard"),
        "depth",
        F.when(page.isNotNull(), in_page).otherwise(F.col("shard_bytes")).cast("long").alias("shard_bytes"),
        (F.col("n_bytes") > limit).alias("oversize"),
    )
