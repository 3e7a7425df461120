"""Ordered folds as chains of block effects.

Rows fall into (key, time block). A block in which nothing unusual happens turns the plain state into the plain state and
is never folded. For the other keys the fold's states at the end of each block are enumerated without knowing where the fold
really stands: a state that survives a block was set by one of few rows (``open_states``). Each such state is then met with
the blocks that can change it: block summaries rule blocks out, and name the first that must change it. Every meeting is a
fold of one block from a known state, so all of them run side by side, and each ends in an enumerated state again. What is
left is to walk these links, one step per change, over a key's block summaries.

So no task folds more than one block's rows in sequence, the number of jobs is fixed, and the result equals the sequential
fold. Block summaries of one key are bounded by its time span divided by the block length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Workers need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Columns = dict[str, np.ndarray]
# States at the end of a block: set by a row of it (its code, from 0), unchanged, or plain.
UNCHANGED, PLAIN = -1, -2


@dataclass
class Fold:
    """What a rule supplies. A state is two doubles, (a, b). Blocks come as one array per column and their borders."""

    key: str
    order: list[str]
    reads: list[str]  # columns of the rows
    known: list[str]  # columns of the block table that its rows need

    def open_states(self, columns: Columns, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the block, code, a, b) of all states other than plain that may stand at a block's end."""
        raise NotImplementedError

    def meets(self, a: float, b: float, blocks: Columns) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks may change the state, and which surely do."""
        raise NotImplementedError

    def leave(self, columns: Columns, starts: np.ndarray, ends: np.ndarray, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The code of the state in which each lane (block entered with (a, b)) leaves its block."""
        raise NotImplementedError

    def rows(self, columns: Columns, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> Columns:
        """Output columns of the rows of blocks entered with (a, b)."""
        raise NotImplementedError


def arrays(batch: pa.Table, names: list[str]) -> Columns:
    """Plain arrays: instants as microseconds, null measures as NaN."""
    out = {}
    for name in names:
        column = batch.column(name).combine_chunks()
        if pa.types.is_timestamp(column.type):
            column = column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min)
        elif pa.types.is_boolean(column.type):
            column = column.fill_null(False)
        out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _whole_blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole blocks with the first and last + 1 row of each; the last block of a batch waits for the next batch."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
        starts = _starts(table, key)
        waiting = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1], starts[1:]
    if waiting is not None:
        yield waiting, np.array([0]), np.array([waiting.num_rows])


def _starts(table: pa.Table, key: str) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    for name in (key, "block"):
        codes = table.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] &= codes[1:] == codes[:-1]
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def _sorted(rows: DataFrame, fold: Fold) -> DataFrame:
    return rows.repartition(fold.key, "block").sortWithinPartitions(fold.key, "block", *fold.order)


def _states(rows: DataFrame, blocks: DataFrame, fold: Fold) -> DataFrame:
    """(key, block, code, a, b) of the states that may stand at the end of ``blocks``."""
    joined = _sorted(rows.join(blocks.select(fold.key, "block", *fold.known), [fold.key, "block"]), fold)
    schema = T.StructType([joined.schema[fold.key], joined.schema["block"], *[T.StructField(n, t) for n, t in (("code", T.LongType()), ("a", T.DoubleType()), ("b", T.DoubleType()))]])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in _whole_blocks(batches, fold.key):
            at, code, a, b = fold.open_states(arrays(table, [*fold.reads, *fold.known]), starts, ends)
            named = table.select([fold.key, "block"]).take(pa.array(starts[at]))
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in named.columns], pa.array(code, pa.int64()), pa.array(a), pa.array(b)], names=[f.name for f in schema.fields])

    return joined.select(fold.key, "block", *fold.order, *[c for c in fold.reads if c not in fold.order], *fold.known).mapInArrow(found, schema)


def _meetings(blocks: DataFrame, states: DataFrame, fold: Fold) -> DataFrame:
    """(key, block, origin, code, a, b): blocks to be folded from a state of block ``origin`` (null before the first)."""
    key, kind = fold.key, blocks.schema["block"].dataType
    schema = T.StructType([blocks.schema[key], T.StructField("block", kind), T.StructField("origin", kind), *[states.schema[c] for c in ("code", "a", "b")]])

    def met(summaries: pa.Table, found: pa.Table) -> pa.Table:
        summaries = summaries.sort_by("block")
        names = [c for c in summaries.column_names if c not in (key, "block")]
        columns, numbers = arrays(summaries, names), summaries["block"].to_pylist()
        place = {block: i for i, block in enumerate(numbers)}
        asked = [(place[s["block"]], s["code"], s["a"], s["b"]) for s in found.select(["block", "code", "a", "b"]).to_pylist()]
        # The plain state matters where an unusual block follows.
        asked += [(i - 1, PLAIN, columns["plain_a"][i], columns["plain_b"][i]) for i in np.flatnonzero(columns["unusual"]).tolist()]
        out = []
        for origin, code, a, b in asked:
            a, b = np.nan if a is None else float(a), np.nan if b is None else float(b)
            later = {c: v[origin + 1 :] for c, v in columns.items()}
            possible, sure = fold.meets(a, b, later)
            if code == PLAIN and len(possible):
                possible[0] = True
            end = int(np.argmax(sure)) + 1 if sure.any() else len(sure)
            out += [(numbers[origin + 1 + i], numbers[origin] if origin >= 0 else None, code, a, b) for i in np.flatnonzero(possible[:end]).tolist()]
        name = summaries[key][0].as_py() if len(summaries) else None
        table = list(zip(*out, strict=True)) or [[]] * 5
        types = [blocks_type, blocks_type, pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([name] * len(out), key_type), *[pa.array(c, t) for c, t in zip(table, types, strict=True)]], names=[f.name for f in schema.fields])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, blocks_type = to_arrow_type(blocks.schema[key].dataType), to_arrow_type(kind)
    return blocks.groupBy(key).cogroup(states.groupBy(key)).applyInArrow(met, schema)


def _left(rows: DataFrame, blocks: DataFrame, meetings: DataFrame, fold: Fold) -> DataFrame:
    """(key, block, origin, code, a, b, exit): the meetings with the state they leave their block in."""
    key = fold.key
    lanes = meetings.groupBy(key, "block").agg(F.collect_list(F.struct("origin", "code", "a", "b")).alias("lanes"))
    joined = _sorted(rows.join(blocks.select(key, "block", *fold.known).join(lanes, [key, "block"]), [key, "block"]), fold)
    inner = joined.schema["lanes"].dataType.elementType.fields
    schema = T.StructType([joined.schema[key], joined.schema["block"], *inner, T.StructField("exit", T.LongType())])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in _whole_blocks(batches, key):
            heads = table.take(pa.array(starts))
            lanes = heads["lanes"].combine_chunks()
            block = np.repeat(np.arange(len(starts)), np.diff(lanes.offsets.to_numpy()))
            flat = lanes.flatten()
            a, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("a", "b"))
            exits = fold.leave(arrays(table, [*fold.reads, *fold.known]), starts, ends, block, a, b)
            named = [heads[c].combine_chunks().take(pa.array(block)) for c in (key, "block")]
            yield pa.RecordBatch.from_arrays([*named, *[flat.field(f.name) for f in inner], pa.array(exits, pa.int64())], names=[f.name for f in schema.fields])

    return joined.select(key, "block", *fold.order, *[c for c in fold.reads if c not in fold.order], *fold.known, "lanes").mapInArrow(done, schema)


def _walked(blocks: DataFrame, left: DataFrame, states: DataFrame, fold: Fold) -> DataFrame:
    """(key, block, a, b): the entry states of all blocks that are unusual or not entered in the plain state."""
    key, kind = fold.key, blocks.schema["block"].dataType
    schema = T.StructType([blocks.schema[key], T.StructField("block", kind), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])

    def walk(summaries: pa.Table, results: pa.Table) -> pa.Table:
        summaries = summaries.sort_by("block")
        numbers, unusual = summaries["block"].to_pylist(), summaries["unusual"].to_pylist()
        place = {block: i for i, block in enumerate(numbers)}
        links: dict[tuple, list] = {}
        values: dict[tuple, tuple] = {}
        for r in results.to_pylist():
            state = (-1 if r["origin"] is None else place[r["origin"]], r["code"])
            values[state] = (r["a"], r["b"])
            if r["block"] is not None:
                links.setdefault(state, []).append((place[r["block"]], r["exit"]))
        out, at, code = [], 0, PLAIN
        while at < len(numbers):
            if code == PLAIN and not unusual[at]:
                at += 1
                continue
            meetings = sorted(links.get((at - 1, code), []))
            end, after = next((m for m in meetings if m[1] != UNCHANGED), (len(numbers) - 1, code))
            out += [(numbers[i], *values[at - 1, code]) for i in range(at, end + 1)]
            at, code = end + 1, after
        name = summaries[key][0].as_py() if len(summaries) else None
        table = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array([name] * len(out), key_type), pa.array(table[0], blocks_type), pa.array(table[1], pa.float64()), pa.array(table[2], pa.float64())], names=[f.name for f in schema.fields])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, blocks_type = to_arrow_type(blocks.schema[key].dataType), to_arrow_type(kind)
    alone = states.select(key, F.lit(None).cast(kind).alias("block"), F.col("block").alias("origin"), "code", "a", "b", F.lit(None).cast("long").alias("exit"))
    return blocks.groupBy(key).cogroup(left.unionByName(alone).groupBy(key)).applyInArrow(walk, schema)


def settle(rows: DataFrame, blocks: DataFrame, fold: Fold, every_block: bool) -> DataFrame:
    """Entry states (key, block, a, b, known columns) of the blocks whose rows must be folded. Starts a fixed number of jobs.

    ``blocks`` has key, block, unusual, plain_a and plain_b (the plain state at its start) and the columns that the fold's
    ``meets`` and ``known`` name. Keys without an unusual block are left out. ``every_block``: usual blocks have open states too.
    """
    key = fold.key
    busy = written(blocks.withColumn("busy", F.bool_or("unusual").over(Window.partitionBy(key))).where("busy").drop("busy"))
    states = written(_states(rows, busy if every_block else busy.where("unusual"), fold))
    meetings = written(_meetings(busy, states, fold))
    entries = _walked(busy, _left(rows, busy, meetings, fold), states, fold)
    return written(entries.join(busy.select(key, "block", *fold.known), [key, "block"]))


def fold_rows(rows: DataFrame, entries: DataFrame, fold: Fold, out: T.StructType) -> DataFrame:
    """The rows of the blocks in ``entries`` with the fold's output columns."""
    joined = _sorted(rows.join(entries, [fold.key, "block"]), fold)
    kept = rows.columns
    schema = T.StructType([*[joined.schema[c] for c in kept], *out.fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in _whole_blocks(batches, fold.key):
            heads = arrays(table.take(pa.array(starts)), ["a", "b"])
            columns = fold.rows(arrays(table, [*fold.reads, *fold.known]), starts, ends, heads["a"].astype(float), heads["b"].astype(float))
            added = [pa.array(columns[f.name], from_pandas=True) for f in out.fields]
            whole = pa.table([*table.select(kept).columns, *added], names=[f.name for f in schema.fields])
            yield from whole.combine_chunks().to_batches()

    return joined.mapInArrow(apply, schema)


def untouched(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Rows outside all folded blocks; these blocks are the few, so they are what is matched."""
    return rows.join(entries.select(key, "block"), [key, "block"], "left_anti")
