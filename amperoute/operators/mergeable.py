"""Aggregates in two steps: first per foreign key, then per dimension attribute (J-1..J-4 with A1..A19).

Facts are reduced on their own key before any join, with map-side combining, so a key that owns a large
share of the rows is already one row when the shuffle and the dimension join see it. Dimensions carry no
broadcast hint: Spark broadcasts them by measured size and shuffles them beyond that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """One output column: what each key computes, and how keys combine."""

    kind: str
    of: Column | None = None

    def partial(self, name: str) -> list[Column]:
        of = self.of if self.of is not None else F.lit(1)
        if self.kind == "mean":
            return [F.sum(of.cast("double")).alias(f"{name}__s"), F.count(of).alias(f"{name}__n")]
        if self.kind == "ratio":
            raise ValueError("build ratios from two sums")
        function = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[self.kind]
        return [function(of).alias(name)]

    def final(self, name: str) -> Column:
        if self.kind == "mean":
            return F.try_divide(F.sum(f"{name}__s"), F.sum(f"{name}__n")).alias(name)
        if self.kind == "count":
            return F.coalesce(F.sum(name), F.lit(0)).alias(name)
        function = {"sum": F.sum, "min": F.min, "max": F.max}[self.kind]
        return function(name).alias(name)


def count(of: Column | None = None) -> Part:
    return Part("count", of)


def total(of: Column) -> Part:
    return Part("sum", of)


def mean(of: Column) -> Part:
    return Part("mean", of)


def smallest(of: Column) -> Part:
    return Part("min", of)


def largest(of: Column) -> Part:
    return Part("max", of)


def reduce_by_key(facts: DataFrame, keys: Sequence[str | Column], parts: Mapping[str, Part]) -> DataFrame:
    return facts.groupBy(*keys).agg(*[c for name, part in parts.items() for c in part.partial(name)])


def combine(reduced: DataFrame, groups: Sequence[str | Column], parts: Mapping[str, Part]) -> DataFrame:
    finals = [part.final(name) for name, part in parts.items()]
    return reduced.groupBy(*groups).agg(*finals) if groups else reduced.agg(*finals)
