"""Codes to labels and display buckets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label tables.
BATTERY_CHEMISTRY = {
    1: "Lithium-Ion Batteries",
    2: "Nickel-Metal Hydride Batteries",
    3: "Lead-Acid Batteries",
    4: "Ultracapacitors",
    5: "Other",
}
CHARGER_TYPE = {"1": "Level 1", "2": "Level 2", "3": "DCFC", "4": "Other"}
CONNECTOR_TYPE = {
    "1": "J1772",
    "2": "CCS connector",
    "3": "CHAdeMO connector",
    "4": "Tesla connector",
    "5": "Mennekes connector",
    "6": "Other",
}
PALETTE_SIZE = 24


def _lookup(labels: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])


def label(code: Column, labels: Mapping) -> Column:
    """One code; unknown codes stay."""
    return F.coalesce(F.try_element_at(_lookup(labels), code), code.cast("string"))


def labels_of_list(codes: Column, labels: Mapping) -> Column:
    """Comma list of codes to comma list of labels; unknown codes stay, null gives an empty text."""
    table = _lookup(labels)
    parts = F.transform(F.split(F.coalesce(codes, F.lit("")), ","), lambda c: F.trim(c))
    named = F.transform(F.filter(parts, lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.array_join(named, ", ")


def text_or(x: Column, default: str = "Unknown") -> Column:
    """Null or blank becomes the default."""
    text = x.cast("string")
    return F.when(F.trim(text) == "", F.lit(default)).otherwise(F.coalesce(text, F.lit(default)))


def location_bucket(x: Column) -> Column:
    """C26."""
    return (
        F.when(x.isNull(), F.lit("Unknown"))
        .when(F.lower(F.trim(x)) == "in-house", F.lit("In-house"))
        .otherwise(F.lit("Outsourced"))
    )


def warranty_bucket(x: Column) -> Column:
    """Only an explicit true counts as covered."""
    return F.when(x, F.lit("Yes")).otherwise(F.lit("No"))
