"""Conversation structure repair by Four-Russians block tables over a four-state edit automaton.

A repaired conversation's role initials read ``(s?(ua)+)?``. Before each row the automaton is at the START, after a system
row (S), after a user row (U) or after an assistant row (A). Each row is one of nine symbols: to be deleted, or one of four
role initials (s, u, a, other), truncated or not. The costs to go from the four states, less their minimum, take few values
(their differences are bounded), so the step of a cost vector over any block of ``BLOCK`` symbols is precomputed once: next
vector, cost added, and the state each entry state leaves the block in.

Costs run from a conversation's end to its start, block by block, by lookup. The trace runs the other way through the blocks,
expands each one from the vector at its end, and takes the least letter among the cheapest edits. At any state each letter
names at most one edit, and every step that keeps the cost to go leads to a cheapest end, so this gives the ASCII-least audit.

Spark deals the rows. Rows of a conversation that agree in all columns are one row with a count. Rows are ranged and sorted by
(conversation, turn, ...), so a conversation of any size falls into pieces, one per partition. A piece at the border of a
partition first reports what it does to every vector and state; these few reports (two per partition) are chained per
conversation, and tell each piece its last vector and its first state. Only the hash of a conversation that spans
partitions must run through its rows in sequence; it streams over pieces of about ``PIECE_CHARS``.

Defined results: a null role or text is one space; null turns come first and count neither as turn nor as gap; rows of one turn
are taken by role, then by the SHA-256 of their text; a null conversation is a conversation. Conversations without rows
have zeros, an empty audit and the hash of nothing. Texts of any length are kept whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .rows import run_token, travels, worker_cache

travels(__name__)

BLOCK = 4
PIECE_CHARS = 1_000_000
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
# Where an inserted or rerolled row leads from each state, and the role it gets.
NEEDED = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
# Costs to go at a conversation's end: what is missing is inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)
# Symbols: 0 is deleted, 1 + 2 * initial + truncated, and one that stands for no row.
INITIALS = "sua"
NOTHING = 9
SYMBOLS = 10
BLANK_CHARS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def kept_state(state: int, initial: int) -> int | None:
    """The state after a row kept as it is, if its role may stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def edits(symbol: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Edits of one row: letter, cost to go through it, state behind it."""
    out = [("D", DELETE + after[state], state)]
    if symbol:
        initial, extra = (symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED
        if (to := kept_state(state, initial)) is not None:
            out.append(("K", extra + after[to], to))
        out.append(("R", REROLE + extra + after[NEEDED[state]], NEEDED[state]))
    return out


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs to go before a row, rows inserted ahead of it included."""
    if symbol == NOTHING:
        return after
    costs = [min(cost for _, cost, _ in edits(symbol, p, after)) for p in range(4)]
    for _ in range(3):
        costs = [min(costs[p], INSERT + costs[NEEDED[p]]) for p in range(4)]
    return tuple(costs)


def passing(symbol: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least letters of a cheapest way through a row, and the state behind it."""
    if symbol == NOTHING:
        return "", state
    costs, letters = before(symbol, after), ""
    while True:
        ways = [(letter, to) for letter, cost, to in edits(symbol, state, after) if cost == costs[state]]
        if INSERT + costs[NEEDED[state]] == costs[state]:
            ways.append(("I", NEEDED[state]))
        letter, to = min(ways)
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


class Tables:
    """Vectors are numbered, AT_END is 0. ``step``, ``added`` and ``leave`` are indexed by (block, vector behind it)."""

    def __init__(self):
        number, todo = {AT_END: 0}, [AT_END]
        for after in todo:
            for symbol in range(SYMBOLS):
                costs = before(symbol, after)
                plain = tuple(c - min(costs) for c in costs)
                if plain not in number:
                    number[plain] = len(number)
                    todo.append(plain)
        self.vectors = todo
        step, added = np.zeros((SYMBOLS, len(todo)), np.int64), np.zeros((SYMBOLS, len(todo)), np.int64)
        leave, self.letters = np.zeros((SYMBOLS, len(todo), 4), np.int64), {}
        for symbol, (v, after) in itertools.product(range(SYMBOLS), enumerate(todo)):
            costs = before(symbol, after)
            added[symbol, v] = min(costs)
            step[symbol, v] = number[tuple(c - min(costs) for c in costs)]
            for p in range(4):
                self.letters[symbol, v, p] = passing(symbol, p, after)
                leave[symbol, v, p] = self.letters[symbol, v, p][1]
        self.one = step.tolist()
        width = 1
        while width < BLOCK:  # two blocks become one of twice the length; the later half is passed first
            early, late = np.arange(len(step))[:, None, None], step[None]
            added = (added[None] + added[early, late]).reshape(-1, len(todo))
            leave = leave[np.arange(len(step))[None, :, None, None], np.arange(len(todo))[None, None, :, None], leave[early, late]].reshape(-1, len(todo), 4)
            step = step[early, late].reshape(-1, len(todo))
            width *= 2
        self.step, self.added, self.leave = step, added, leave
        self.step_list, self.added_list = step.tolist(), added.tolist()

    def blocks(self, symbols: bytes) -> np.ndarray:
        digits = np.frombuffer(symbols + bytes([NOTHING]) * (-len(symbols) % BLOCK), np.uint8).reshape(-1, BLOCK)
        return digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def effect(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them, and the state that each entry state ends in."""
        vector, state = np.arange(len(self.vectors)), np.tile(np.arange(4), (len(self.vectors), 1))
        for block in self.blocks(symbols)[::-1]:
            state = np.take_along_axis(state, self.leave[block, vector], 1)
            vector = self.step[block, vector]
        return vector, state

    def trace(self, symbols: bytes, last: int, state: int) -> tuple[list[str], int, int, int]:
        """The letters of each symbol, cost added, the vector before the symbols and the state behind them."""
        blocks = self.blocks(symbols).tolist()
        behind, cost = [last] * len(blocks), 0
        for k in range(len(blocks) - 1, -1, -1):
            cost += self.added_list[blocks[k]][last]
            behind[k], last = last, self.step_list[blocks[k]][last]
        out, one, letters = [], self.one, self.letters
        for k, vector in enumerate(behind):
            part = symbols[k * BLOCK : (k + 1) * BLOCK]
            inside = [vector]
            for symbol in reversed(part[1:]):
                inside.append(one[symbol][inside[-1]])
            for symbol, vector_behind in zip(part, reversed(inside), strict=True):
                text, state = letters[symbol, vector_behind, state]
                out.append(text)
        return out, cost, last, state


@dataclass
class Piece:
    """What one partition holds of one conversation."""

    rows: list[tuple]  # turn, role, text, copies, symbol, blank, first

    def symbols(self) -> bytes:
        return b"".join(bytes([s]) + bytes(n - 1) for _, _, _, n, s, _, _ in self.rows)

    def counts(self) -> dict:
        out = dict(blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, first_role=None, last_role=None)
        for turn, role, _, n, symbol, blank, first in self.rows:
            out["blank"] += n * blank
            out["duplicate"] += 0 if blank else n - first
            out["truncated"] += symbol > 0 and symbol % 2 == 0
            if out["last_role"] is None:
                out["first_role"] = role[:1]
            else:
                out["illegal"] += out["last_role"] + role[:1] not in LEGAL
            out["illegal"] += n - 1
            out["last_role"] = role[:1]
            if turn is not None and turn != out["high"]:
                out["turns"] += 1
                out["low"] = turn if out["low"] is None else out["low"]
                out["high"] = turn
        return out

    def repaired(self, letters: list[str], state: int) -> Iterator[tuple[str, list[str]]]:
        """Per row its letters and the repaired lines."""
        at = 0
        for _, role, text, n, _, _, _ in self.rows:
            lines, seen = [], "".join(letters[at : at + n])
            at += n
            for letter in seen:
                if letter == "K":
                    lines.append(f"{role}:{text}")
                    state = kept_state(state, INITIALS.index(role[:1]))
                elif letter != "D":
                    lines.append(f"{ROLE[state]}:{text if letter == 'R' else ''}")
                    state = NEEDED[state]
            yield seen, lines


def _closing(state: int) -> tuple[str, list[str]]:
    """What is inserted behind a conversation's last row."""
    letters, lines = "", []
    while AT_END[state]:
        letters, lines, state = letters + "I", [*lines, f"{ROLE[state]}:"], NEEDED[state]
    return letters, lines


COLUMNS = ["turn", "role", "text", "copies", "symbol", "blank", "first"]


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str], key: str) -> Iterator[tuple[object, list[tuple]]]:
    """Successive (conversation, rows) of a sorted partition."""
    at, rows = None, []
    for batch in batches:
        keys, values = batch.column(key).to_pylist(), zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
        for conversation, row in zip(keys, values, strict=True):
            if rows and conversation != at:
                yield at, rows
                rows = []
            at = conversation
            rows.append(row)
    if rows:
        yield at, rows


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, ``symbol``, ``blank`` and ``first`` (no equal role and text in an earlier turn)."""
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    # (is not null, turn): null turns come first
    when = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    said = distinct.groupBy("conv", "role", "digest").agg(F.min(when).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("conv", "role", "digest")]
    marked = distinct.alias("d").join(said.alias("e"), same[0] & same[1] & same[2], "left").select("d.*", "e.earliest")
    last = F.substring(F.rtrim("text", F.lit(BLANK_CHARS)), -1, 1)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = marked.withColumns({"blank": last == "", "first": F.coalesce(F.col("earliest") == when, F.lit(True))})
    symbol = F.when(F.col("blank") | ~F.col("first"), 0).otherwise(1 + 2 * code + (~last.isin(".", "!", "?")).cast("int"))
    return marked.select("conv", "digest", *[symbol.alias(c) if c == "symbol" else F.col(c) for c in COLUMNS])


def _borders(ordered: DataFrame, tables_of) -> DataFrame:
    """(conv, part, vector, state): last vector and entry state of the pieces at partition borders, from their chained effects."""
    schema = ordered.select("conv", "part").schema.add("vectors", "binary").add("states", "binary")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, first, latest = tables_of(), True, None

        def report(piece):
            conversation, rows = piece
            vector, state = tables.effect(b"".join(bytes([s]) + bytes(n - 1) for _, n, s in rows))
            return {"conv": conversation, "part": rows[0][0], "vectors": vector.astype(np.uint8).tobytes(), "states": state.astype(np.uint8).tobytes()}

        found = []
        for piece in _pieces(batches, ["part", "copies", "symbol"], "conv"):
            if first:
                found.append(report(piece))
                first, latest = False, None
            else:
                latest = piece
        if latest is not None:
            found.append(report(latest))
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("conv", keys), ("part", pa.int32()), ("vectors", pa.binary()), ("states", pa.binary())]))

    keys = _arrow(ordered, "conv")
    reports = ordered.select("conv", "part", "copies", "symbol").mapInArrow(effects, schema)
    out = ordered.select("conv", "part").schema.add("vector", "integer").add("state", "integer").add("alone", "boolean").add("head", "boolean").add("final", "boolean")

    def chained(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        vector, state = 0, START
        for row in reversed(rows):
            row["vector"], vector = vector, row["vectors"][vector]
        for row in rows:
            row["state"], state = state, row["states"][4 * row["vector"] + state]
            row["alone"], row["head"], row["final"] = len(rows) == 1, row is rows[0], row is rows[-1]
        fields = [("conv", keys), ("part", pa.int32()), ("vector", pa.int32()), ("state", pa.int32()), ("alone", pa.bool_()), ("head", pa.bool_()), ("final", pa.bool_())]
        return pa.Table.from_pylist([{name: row[name] for name, _ in fields} for row in rows], pa.schema(fields))

    return reports.groupBy("conv").applyInArrow(chained, out)


def _arrow(frame: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[column].dataType)


NUMBERS = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]
ENDS = ["low", "high"]
TEXTS = ["first_role", "last_role", "audit", "lines"]


def repair(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation that has rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Starts jobs."""
    ensure_checkpoint_dir(rows.sparkSession)
    token = run_token()
    tables_of = lambda: worker_cache(token, Tables)
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), told(role).alias("role"), told(text).alias("text"))
    order = ["conv", "turn", "role", "digest"]
    ordered = _marked(read).repartitionByRange(*order).sortWithinPartitions(*order).drop("digest").withColumn("part", F.spark_partition_id()).checkpoint()
    borders = _borders(ordered, tables_of).checkpoint()
    # At most two rows per partition, so small enough for every task.
    told_borders = F.broadcast(borders.withColumnRenamed("conv", "at").withColumnRenamed("part", "in_part"))
    joined = ordered.join(told_borders, F.col("conv").eqNullSafe(F.col("at")) & (F.col("part") == F.col("in_part")), "left")
    joined = joined.select("conv", "part", *COLUMNS, "vector", "state", "alone", "head", "final")

    keys = _arrow(ordered, "conv")
    fields = [("conv", keys), ("part", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in NUMBERS + ENDS], *[(c, pa.string()) for c in TEXTS], ("n_lines", pa.int64()), ("digest", pa.string())]
    schema = ordered.select("conv", "part").schema.add("seq", "integer")
    for c in NUMBERS + ENDS:
        schema = schema.add(c, "long")
    for c in TEXTS:
        schema = schema.add(c, "string")
    schema = schema.add("n_lines", "long").add("digest", "string")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out, size = tables_of(), [], 0
        for key, found in _pieces(batches, [*COLUMNS, "part", "vector", "state", "alone", "head", "final"], "conv"):
            part, vector, state, alone, head, final = found[0][7:]
            inner = vector is None or alone
            if inner:
                vector, state, head, final = 0, START, True, True
            piece = Piece([row[:7] for row in found])
            letters, cost, start, left = tables.trace(piece.symbols(), vector, state)
            row = {"conv": key, "part": part, "seq": 0, **piece.counts(), "cost": cost + (tables.vectors[start][START] if head else 0)}
            tail = [_closing(left)] if final else []
            audit, lines, held = [], [], 0
            for seen, some in itertools.chain(piece.repaired(letters, state), tail):
                audit.append(seen)
                lines += some
                held += len(seen) + sum(map(len, some))
                if not inner and held > PIECE_CHARS:
                    out.append(row | {"audit": "".join(audit), "lines": "\n".join(lines), "n_lines": len(lines), "digest": None})
                    size += held
                    row = {"conv": key, "part": part, "seq": row["seq"] + 1, **{c: 0 for c in NUMBERS}}
                    audit, lines, held = [], [], 0
            if inner:
                row |= {"audit": "".join(audit), "lines": None, "n_lines": 0, "digest": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
            else:
                row |= {"audit": "".join(audit), "lines": "\n".join(lines), "n_lines": len(lines), "digest": None}
            out.append(row)
            size += held if not inner else 1000
            if size > PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    pieces = joined.mapInArrow(traced, schema).checkpoint()
    names = ["conv", *NUMBERS, *ENDS, "audit", "digest"]
    spanning = pieces.where("digest is null").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    whole = pieces.where("digest is not null").select(*names).unionByName(spanning.mapInArrow(_streamed(names, keys), pieces.select(*names).schema))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return whole.select(F.col("conv").alias(conversation), gaps.alias("gaps"), *NUMBERS[:5], "audit", F.col("digest").alias("repaired_sha256"))


def _streamed(names: list[str], keys: pa.DataType):
    """Sums and hash of conversations whose pieces come in order; nothing is kept of a piece but its letters."""
    fields = [("conv", keys), *[(c, pa.int64()) for c in NUMBERS + ENDS], ("audit", pa.string()), ("digest", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, role, lines, audit, digest = None, None, 0, [], None

        def finished():
            return pa.RecordBatch.from_pylist([{**row, "audit": "".join(audit), "digest": digest.hexdigest()}], pa.schema(fields))

        for batch in batches:
            for piece in batch.to_pylist():
                if row is None or piece["conv"] != row["conv"]:
                    if row is not None:
                        yield finished()
                    row, role, lines, audit, digest = {"conv": piece["conv"], **{c: 0 for c in NUMBERS}, "low": None, "high": None}, None, 0, [], hashlib.sha256()
                for c in NUMBERS:
                    row[c] += piece[c]
                if piece["first_role"] is not None:
                    row["illegal"] += role is not None and role + piece["first_role"] not in LEGAL
                    role = piece["last_role"]
                if piece["low"] is not None:
                    row["turns"] -= piece["low"] == row["high"]
                    row["low"] = piece["low"] if row["low"] is None else row["low"]
                    row["high"] = piece["high"]
                if piece["n_lines"]:
                    digest.update((b"\n" if lines else b"") + piece["lines"].encode())
                    lines += piece["n_lines"]
                audit.append(piece["audit"])
        if row is not None:
            yield finished()

    return run
