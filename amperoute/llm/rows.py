"""Shared helpers: carrying input rows whole, code that travels to workers, caches of one run."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, the separators between words, as the body of a character class.
SPACE = r"\x20\x09-\x0D"
ROW = "row"


def packed(docs: DataFrame, **columns: str) -> DataFrame:
    """The columns an operator reads under its own names, and the whole input row in one struct ``row``.

    Extra columns of any name, also names the operator gives its results, stay inside the struct.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
    return docs.select(row, *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def words_of(text: Column) -> Column:
    """All runs of anything but ASCII white space; no words for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1)), F.array().cast("array<string>"))


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called so (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of the whole row: equal rows agree."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def travels(module: str) -> None:
    """Workers need not have this package installed: the module's functions travel with the task."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def run_token() -> str:
    """A new name for caches that live as long as one run of a query."""
    return uuid.uuid4().hex


def worker_cache(token: str, make):
    """What ``make`` returns, kept by this worker process for all tasks of the run ``token``; an older run's is freed."""
    kept = sys.modules.setdefault("_run_cache", types.ModuleType("_run_cache"))
    if getattr(kept, "token", None) != token:
        kept.token, kept.value = token, make()
    return kept.value


class Memory:
    """What ``learn`` found for keys, kept in two generations of at most about ``limit`` each: keys asked for again stay.

    ``learn`` takes distinct new keys and gives (key, value) pairs; values are never None.
    """

    def __init__(self, limit: int, learn):
        self.limit, self.learn = limit, learn
        self.now, self.before = {}, {}

    def get(self, keys: list) -> list:
        """The values of ``keys``, in order."""
        found, gaps, at = list(map(self.now.get, keys)), [], -1
        try:
            while True:
                at = found.index(None, at + 1)
                gaps.append(at)
        except ValueError:
            pass
        if gaps:
            lacking = {keys[at] for at in gaps}
            kept = {k: self.before[k] for k in lacking if k in self.before}
            self.now.update(kept)
            if len(kept) < len(lacking):
                self.now.update(self.learn([k for k in lacking if k not in kept]))
            for at in gaps:
                found[at] = self.now[keys[at]]
            if len(self.now) > self.limit:
                self.now, self.before = {}, self.now
        return found


travels(__name__)
