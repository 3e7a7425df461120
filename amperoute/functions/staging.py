"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluated(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed at this point.

    The optimizer merges projections and pushes filters below them, which copies a parser or a zone
    conversion into each place its result is used. It does neither across a generator, so the columns pass
    through a one-element ``inline``. Use after parsing text, never directly on a scan.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.array(row)))
