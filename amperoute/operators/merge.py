"""Upserts (J1-J9, K3). Plain file tables have no MERGE, so a merge is a full outer join on the keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import not_stored

POLICIES = ("insert_absent", "overwrite", "fill_nulls")


def _sided(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    return df.select(
        *[F.col(k).alias(f"{side}_k_{k}") for k in keys],
        *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys],
        F.lit(True).alias(f"{side}_here"),
    )


def _lone(keys: Sequence[str]) -> Column:
    """0 for rows with a full key, a number of its own for any other row: such rows meet nobody and spread over tasks."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return F.when(missing, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long"))


def require_unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; reading them fails if a full key occurs twice. The test is a filter, so no plan can drop it."""
    counted = source.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    failed = F.raise_error(F.concat(F.lit("source keys are not unique: "), F.to_json(F.struct(*keys)))).cast("boolean")
    return counted.where(F.when(F.col("__n") > 1, failed).otherwise(F.lit(True))).drop("__n")


def merge_into(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    policy: str = "overwrite",
    columns: Sequence[str] | None = None,
    null_safe_keys: bool = False,
) -> DataFrame:
    """The merged table plus ``merge_action`` per row: kept, inserted, updated or unchanged.

    insert_absent (J1): stored rows win. overwrite (J2, J3): incoming values replace stored ones, and a row
    counts as updated only if some value differs. fill_nulls (J5): only empty stored values are filled.
    ``columns`` limits which columns a merge may write (J4); others keep the stored value and are null on
    insert unless the source has them. Null keys match nothing, as in SQL, unless ``null_safe_keys`` (J6).
    Source keys must be unique (J8), else reading the result fails: see unique_source.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    keys = list(keys)
    writable = set(columns if columns is not None else [c for c in source.columns if c not in keys])
    old, new = _sided(target, keys, "old"), _sided(source, keys, "new")
    condition = None
    if not null_safe_keys:
        old = old.withColumn("old_lone", _lone([f"old_k_{k}" for k in keys]))
        new = new.withColumn("new_lone", _lone([f"new_k_{k}" for k in keys]))
        condition = F.col("old_lone") == F.col("new_lone")
        # the window has the join's own partitioning
        new = require_unique(new, ["new_lone", *[f"new_k_{k}" for k in keys]])
    else:
        new = require_unique(new, [f"new_k_{k}" for k in keys])
    for k in keys:
        a, b = F.col(f"old_k_{k}"), F.col(f"new_k_{k}")
        term = a.eqNullSafe(b) if null_safe_keys else a == b
        condition = term if condition is None else condition & term
    joined = old.join(new, condition, "full_outer")

    stored, arrived = F.col("old_here").isNotNull(), F.col("new_here").isNotNull()
    changes: list[Column] = []
    output: list[Column] = []
    for field in target.schema.fields:
        name = field.name
        if name in keys:
            output.append(F.when(stored, F.col(f"old_k_{name}")).otherwise(F.col(f"new_k_{name}")).alias(name))
            continue
        before = F.col(f"old_{name}")
        if name not in source.columns:
            output.append(before.alias(name))
            continue
        after = F.col(f"new_{name}").cast(field.dataType)
        if name not in writable or policy == "insert_absent":
            value = F.when(stored, before).otherwise(after)
        elif policy == "overwrite":
            value = F.when(arrived, after).otherwise(before)
        else:
            value = F.coalesce(before, after)
        changes.append(stored & arrived & ~before.eqNullSafe(value))
        output.append(value.alias(name))
    changed = F.lit(False)
    for c in changes:
        changed = changed | c
    action = (
        F.when(F.col("new_here").isNull(), F.lit("kept"))
        .when(F.col("old_here").isNull(), F.lit("inserted"))
        .when(changed, F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    return joined.select(*output, action.alias("merge_action"))


def unique_source(source: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One incoming row per full key, the first by the given order; rows without a full key all stay."""
    ranked = source.withColumn("__lone", _lone(keys))
    rank = F.row_number().over(Window.partitionBy("__lone", *keys).orderBy(*order))
    return ranked.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__lone")


def insert_distinct(target: DataFrame, source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct incoming rows that differ from every stored row in some column (nulls equal)."""
    return not_stored(source.select(*columns).distinct(), target.select(*columns), columns, null_safe=True)


def without_fleet_sessions(sessions: DataFrame, charger: DataFrame, fleet: DataFrame, fleet_name: str) -> DataFrame:
    """All sessions but those at one fleet's chargers."""
    theirs = charger.join(fleet.where(F.col("fleet_name") == fleet_name).select(F.col("id").alias("fleet_id")), "fleet_id")
    return sessions.join(theirs.select(F.col("id").alias("charger_id")), "charger_id", "left_anti")


def overlap_counts(
    incoming: DataFrame, stored: DataFrame, keys: Sequence[str], digits: Mapping[str, int]
) -> DataFrame:
    """K3: incoming rows, overlap, new, changed and unchanged, values equal after rounding to ``digits``."""
    keys = list(keys)
    old = stored.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in digits], F.lit(True).alias("__old"))
    joined = incoming.select(*keys, *digits).join(old, keys, "left")
    same = F.lit(True)
    for c, n in digits.items():
        same = same & F.round(c, n).eqNullSafe(F.round(f"__old_{c}", n))
    overlap = F.col("__old").isNotNull()
    return joined.agg(
        F.count("*").alias("incoming"),
        F.count_if(overlap).alias("overlap_existing"),
        F.count_if(~overlap).alias("new_rows"),
        F.count_if(overlap & ~same).alias("changed_overlap"),
        F.count_if(overlap & same).alias("unchanged_overlap"),
    )
