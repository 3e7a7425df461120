"""Headers, columns and keys (B1-B6, B10, B11). Column work happens on the schema; no job is started."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """A source lacks columns its loader needs."""


def normalize_headers(df: DataFrame) -> DataFrame:
    """B1."""
    return df.toDF(*[re.sub(r"\s+", " ", name).strip() for name in df.columns])


def require(df: DataFrame, columns: Iterable[str], source: str = "source") -> DataFrame:
    """B2."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"{source} lacks {missing}")
    return df


def find_column(columns: Sequence[str], *, exact: Sequence[str] = (), parts: Sequence[str] = (), prefix: str = "") -> str | None:
    """First exact alias, else first header with all parts, else first header with the prefix (case-blind)."""
    lowered = {c.lower(): c for c in reversed(columns)}
    for alias in exact:
        if alias.lower() in lowered:
            return lowered[alias.lower()]
    for c in columns:
        if parts and all(p.lower() in c.lower() for p in parts):
            return c
        if prefix and c.lower().startswith(prefix.lower()):
            return c
    return None


def resolve(df: DataFrame, wanted: Mapping[str, Mapping], source: str = "source") -> DataFrame:
    """Project to standard names; ``wanted`` maps a name to find_column arguments."""
    found = {name: find_column(df.columns, **how) for name, how in wanted.items()}
    missing = sorted(name for name, column in found.items() if column is None)
    if missing:
        raise MissingColumns(f"{source} lacks {missing}")
    return df.select(*[df[f"`{column}`"].alias(name) for name, column in found.items()])


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The target's columns and types; columns the source lacks are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def map_codes(df: DataFrame, code: Column, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Constant code mapping as an expression; unknown codes become null."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return df.withColumn(out, F.try_element_at(table, code))


def resolve_key(
    df: DataFrame,
    dim: DataFrame,
    on: Mapping[str, str],
    key: str,
    out: str,
    *,
    unmapped: str = "null",
) -> DataFrame:
    """B6, J-5: natural code to key. ``unmapped`` is 'drop', 'null' or 'fail' (the job errors on first sight).

    ``on`` maps fact columns to dimension columns; include the fleet so codes only match inside it.
    """
    side = dim.select(*[F.col(d).alias(f"__{f}") for f, d in on.items()], F.col(key).alias(out))
    condition = None
    for f in on:
        term = F.col(f) == F.col(f"__{f}")
        condition = term if condition is None else condition & term
    joined = df.join(side, condition, "inner" if unmapped == "drop" else "left").drop(*[f"__{f}" for f in on])
    if unmapped == "fail":
        # A filter, so no plan can drop the test with the column.
        failed = F.raise_error(F.concat(F.lit("unmapped key "), F.to_json(F.struct(*on)))).cast("boolean")
        joined = joined.where(F.when(F.col(out).isNull(), failed).otherwise(F.lit(True)))
    return joined


def rekey(df: DataFrame, dim: DataFrame, column: str, code: str, key: str = "id") -> DataFrame:
    """Codes to keys, only where the column still holds text; orphans fail the job."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    order = df.columns
    return resolve_key(
        df.withColumnRenamed(column, "__code"), dim, {"__code": code}, key, column, unmapped="fail"
    ).select(*order)


def fill_dimension(existing: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add missing members, fill only empty attributes of present ones."""
    from .merge import merge_into

    return merge_into(existing, seeds, keys, policy="fill_nulls").drop("merge_action")
