"""Vendor files: discovery, CSV scans, ingestion ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merge_into

_DATED = r"/(\d{8})/([^/]+)$"
LEDGER = "path string, hash string"


def relative(path_column: str, root: str) -> Column:
    """K2: the path below ``root`` with forward slashes."""
    clean = F.regexp_replace(F.url_decode(F.regexp_replace(path_column, r"\+", "%2B")), r"\\", "/")
    return F.regexp_replace(clean, r"^.*?" + _escaped(root.rstrip("/")) + "/", "")


def _escaped(text: str) -> str:
    return r"\Q" + text + r"\E"


def list_files(spark: SparkSession, root: str, *, pattern: str = "*", with_hash: bool = False) -> DataFrame:
    """Files below ``root``: path, date folder and stem; contents are read only for the hash."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    name = F.regexp_extract("path", _DATED, 2)
    listed = files.select(
        F.col("path").alias("uri"),
        relative("path", root).alias("path"),
        F.nullif(F.regexp_extract("path", _DATED, 1), F.lit("")).alias("folder"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"),
        *([F.md5("content").alias("hash")] if with_hash else []),
    )
    return listed


def dated_folders(files: DataFrame, workbook: str) -> DataFrame:
    """Dated folders; weekly ones hold CSV files, monthly ones the named workbook."""
    return files.where("folder is not null").groupBy("folder").agg(
        F.bool_or(F.col("extension") == "csv").alias("weekly"),
        F.bool_or(F.element_at(F.split("path", "/"), -1) == workbook).alias("monthly"),
    )


def entity_files(files: DataFrame, known: Sequence[str]) -> DataFrame:
    """CSV files whose stem is a known entity code."""
    return files.where((F.col("extension") == "csv") & F.col("folder").isNotNull() & F.col("stem").isin(*known))


def not_ingested(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """K1: files whose (path, content hash) the ledger lacks; a changed file comes again."""
    return files.join(ledger.select("path", "hash"), ["path", "hash"], "left_anti")


def record_ingested(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """K1: the ledger after these files; a path keeps its newest hash."""
    return merge_into(ledger, files.select("path", "hash"), ["path"]).drop("merge_action")


def read_ledger_json(spark: SparkSession, path: str, root: str) -> DataFrame:
    """A ledger kept as one JSON object of path to hash."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "hash"))
    return entries.select(relative("path", root).alias("path"), "hash")


def read_csv(spark: SparkSession, paths: str | Sequence[str], *, encoding: str = "UTF-8", root: str | None = None) -> DataFrame:
    """All columns as text, plus the file's stem as ``code``, its path and the row's place.

    Columns come from the files' header; the scan infers no types. ``row_no`` rises within a file.
    """
    rows = spark.read.option("header", True).option("encoding", encoding).option("multiLine", False).csv(
        list(paths) if not isinstance(paths, str) else paths
    )
    return rows.select(
        "*",
        F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]*$", 1).alias("code"),
        (relative("_metadata.file_path", root) if root else F.col("_metadata.file_path")).alias("path"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _windows_punctuation() -> tuple[str, str]:
    """The characters Windows-1252 puts where ISO-8859-1 has control codes, as two aligned texts."""
    pairs = []
    for code in range(0x80, 0xA0):
        shown = bytes([code]).decode("cp1252", errors="ignore")
        if shown:
            pairs.append((chr(code), shown))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """S3: files that are not valid UTF-8 are taken as Windows-1252.

    The CSV source reads ISO-8859-1, which differs in 27 characters; those are translated afterwards. Only
    file names come to the driver, as they do for any file listing.
    """
    files = spark.read.format("binaryFile").load(path)
    marked = files.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8")).collect()
    frames = []
    if any(f.utf8 for f in marked):
        frames.append(read_csv(spark, [f.path for f in marked if f.utf8]))
    if not all(f.utf8 for f in marked):
        rows = read_csv(spark, [f.path for f in marked if not f.utf8], encoding="ISO-8859-1")
        control, shown = _windows_punctuation()
        names = [n.translate(str.maketrans(control, shown)) for n in rows.columns]
        texts = [
            F.translate(F.col(f"`{f.name}`"), control, shown).alias(name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`")
            for f, name in zip(rows.schema.fields, names)
        ]
        frames.append(rows.select(*texts))
    if not frames:
        raise FileNotFoundError(path)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
