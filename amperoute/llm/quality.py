"""Quality rules: rule counts of every text, and a hashed n-gram log-likelihood ratio.

Words, word endings (character trigrams) and pairs of neighbouring words of a text are hashed into a fixed number of
buckets, one table per kind. Two multinomials over the buckets of a kind are counted: one over all documents (raw), one
over trusted documents (target). A text's score is the mean over its n-grams of log(target share / raw share); texts
below a fixed threshold are rejected.

Defined results: a null or blank text has no words and fails the base rules; its score is 0. Repeated rows
are judged row by row and count as often as they occur. Without trusted documents the target equals the raw
counts and every score is 0. Extra columns stay inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .rows import ROW, SPACE, packed, row_hash, unused, words_of

# Kinds of n-grams, and buckets of each: the ratio table has at most 3 * 2^18 rows at any size of the input.
KINDS = ("word", "ending", "pair")
BUCKETS = 1 << 18
# Trusted documents that the target is counted on, at most (those with the smallest hashed ids).
TRUSTED_DOCS = 20_000
# N-grams of prior evidence per bucket.
PRIOR = 4.0
# Mean log ratio per n-gram below which a text is rejected.
THRESHOLD = -0.3
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = "[#*$%&|<>]"


def _pairs(hashes: str, apart: int):
    """A hash of each element with the one ``apart`` places on; shorter by that number."""
    rest = F.slice(hashes, F.lit(apart + 1), F.greatest(F.size(hashes) - apart, F.lit(0)))
    return F.zip_with(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - apart, F.lit(0))), rest, lambda x, y: F.xxhash64(x, y))


def _grams(word: Column, pair: Column, buckets: int) -> tuple[Column, ...]:
    """Buckets of a word's n-grams, a range of them for each of ``KINDS``: itself, its last three characters, and the
    hash of it and the next word (null for the last)."""
    hashes = (F.xxhash64(word), F.xxhash64(F.lit("ending"), F.substring(word, -3, 3)), pair)
    return tuple((F.pmod(h, F.lit(buckets)) + k * buckets).cast("int") for k, h in enumerate(hashes))


def _placed(words: str, pairs: str) -> Column:
    """(word, pair) of every word."""
    return F.arrays_zip(F.col(words).alias("word"), F.col(pairs).alias("pair"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``n_repeat_words``: words inside windows that occur twice or more. Equal windows meet by sorting (hash, start).

    The hash of eight words is made from pairs of pairs of pairs.
    """
    nothing = F.array().cast("array<bigint>")
    rows = rows.withColumn("fours", _pairs("doubles", 2)).drop("doubles")
    again = F.size(F.array_distinct("fours")) < F.size("fours")
    rows = rows.withColumn("windows", F.when(again, _pairs("fours", 4)).otherwise(nothing)).drop("fours")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none))
    same = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    rows = rows.withColumn("starts", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    # Each repeated window covers its words up to the start of the next one.
    step = lambda s, k: F.coalesce(F.least(F.lit(WINDOW_WORDS), F.get("starts", k + 1) - s), F.lit(WINDOW_WORDS))
    covered = F.aggregate(F.transform("starts", step), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered).drop("placed", "starts", "windows")


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long), base_failed, ``words``, ``pairs``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    rows = packed(docs, text=text).withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    rows = rows.select(
        ROW, "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("doubles", _pairs("hashes", 1)).drop("hashes").withColumn("pairs", F.col("doubles"))
    return _with_repeats(rows).withColumn("base_failed", failed)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """(bucket, ratio) of every bucket that occurs: the log of target share over raw share within its kind, both drawn
    towards the raw share by ``PRIOR`` n-grams, so that n-grams too rare to tell weigh little.

    Raw counts cover every document. ``trusted`` holds ids; at most ``trusted_docs`` of them are used, so the
    joined side stays below 16 bytes times that number and is broadcast. The counts are checkpointed.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    ids = trusted.select(F.col(f"`{key}`").alias("key")).where("key is not null").distinct()
    ids = ids.orderBy(F.xxhash64("key"), "key").limit(trusted_docs).withColumn("is_target", F.lit(1))
    words = docs.select(F.col(f"`{key}`").alias("key"), words_of(F.col(f"`{text}`")).alias("words"))
    words = words.join(F.broadcast(ids), "key", "left").select("is_target", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    words = words.select("is_target", "words", _pairs("hashes", 1).alias("pairs")).select("is_target", F.inline(_placed("words", "pairs")))
    grams = words.select("is_target", F.explode(F.array(*_grams(F.col("word"), F.col("pair"), buckets))).alias("bucket")).where("bucket is not null")
    # One partial sum per bucket and task leaves the scan.
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_target").alias("target"))
    counts = counts.withColumn("kind", F.floor(F.col("bucket") / buckets)).checkpoint()
    totals = counts.groupBy("kind").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    expected = F.col("raw") * F.col("all_target") / F.col("all_raw")
    ratio = F.log((F.col("target") + F.lit(PRIOR)) / (expected + F.lit(PRIOR)))
    return counts.join(F.broadcast(totals), "kind").select("kind", "bucket", ratio.alias("ratio"))


def verdicts(docs: DataFrame, trusted: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """The ``carry`` columns (small ones; they become keys of the sum), the rule counts, ``score`` (mean log ratio per
    n-gram) and ``kept``, for every row.

    The ratio table has a fixed size, so each kind's part is broadcast and joined on the bucket. A text's words are
    summed in the task that split them; one row per document leaves it.
    """
    table = log_ratios(docs, trusted, text, key, buckets, trusted_docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = F.struct(*[F.col(f"{ROW}.`{c}`") for c in carry]).alias("carried")
    # The number of a row only keeps the rows of one scan apart; it is never compared with another scan's.
    rows = rule_counts(docs, text).select(F.monotonically_increasing_id().alias("n"), kept, *counts, "words", "pairs")
    rows = rows.select("n", "carried", *counts, F.inline_outer(_placed("words", "pairs")))
    rows = rows.select("n", "carried", *counts, *[g.alias(kind) for kind, g in zip(KINDS, _grams(F.col("word"), F.col("pair"), buckets), strict=True)])
    for k, kind in enumerate(KINDS):
        part = table.where(F.col("kind") == k).select(F.col("bucket").alias(kind), F.col("ratio").alias(f"{kind}_ratio"))
        rows = rows.join(F.broadcast(part), kind, "left")
    each = sum((F.coalesce(f"{kind}_ratio", F.lit(0.0)) for kind in KINDS), F.lit(0.0))
    summed = rows.groupBy("n", "carried", *counts).agg(F.sum(each).alias("total"))
    n_grams = len(KINDS) * F.col("n_words") - 1  # the last word begins no pair
    score = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.col("total") / n_grams)
    scored = summed.select("carried.*", *counts, score.alias("score"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def kept_rows(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are kept. Equal rows are judged alike, so a hash of the whole row names the rejected."""
    mark = unused("row_hash", docs.columns)
    marked = docs.withColumn(mark, row_hash(docs))
    judged = verdicts(marked, trusted, (mark,), text, key, **options)
    return marked.join(judged.where(~F.col("kept")).select(mark).distinct(), mark, "left_anti").drop(mark)
