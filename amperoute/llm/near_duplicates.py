"""N-gram Jaccard join by parity sketches.

A document's set are its distinct five-word shingles, as 64-bit hashes. Per size band the hashes fall into many cells,
and each cell holds the XOR of its hashes: one element more or less changes one cell, so the number of cells in
which two sketches differ is at most the size of the symmetric difference. For a similarity of at least 3/4 that
difference is at most a third of a set, so of any third-plus-one of a sketch's non-empty cells one must be equal in the
other: documents that link meet in a cell (pigeonhole). Cells are chosen rarest first, by one count table of fixed
size, so that shared passages are joined on only where nothing else is left.

1. Documents with equal sets form classes; only classes are joined.
2. Classes that share a chosen cell form groups. Each group is first compared with its smallest member only, then
   with a few others. Members of a group that are not connected afterwards are compared with all others of it,
   by their sketches, so no link is lost and a large group of near copies makes no pairs.
3. Candidates are rejected by size and by the Hamming distance of one-bit sketches, which bounds the difference from
   below; the rest are verified on the whole sets.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer than five words
has one shingle; repeated rows form a class; a null id takes part but is never a component's id. Extra columns play no
part. Sets are compared by 64-bit hashes of their shingles and classes by 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ensure_checkpoint_dir
from .components import components
from .rows import row_hash, run_token, travels, unused, worker_cache

travels(__name__)

WORDS = 5
# Links: SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (3, 4)
# Size bands start at these powers: sets of 8^b to 8^(b+1) - 1 shingles.
BAND_BITS = 3
# Cells per band: this many times the largest set of the band; the smallest bands use the hashes themselves.
CELLS_PER_ELEMENT = 4
WHOLE_BANDS = 2
# The count table of cells: fixed size, so it is fetched and sent to the tasks whatever the input.
COUNT_BITS = 20
COUNT_SLICE = 1 << 12
# A group is joined in parts of about this many rows.
PART_ROWS = 20_000
# Further members that a group is compared with, before all that is left is compared.
HUBS = 3
# Marks of the ids whose texts are fetched for verifying: so many bits at any size of the input, in rows of 2^15.
MARK_BITS = 25
MARK_ROW_BITS = 15
# Members of one side that are compared in one piece of work.
BLOCK_ROWS = 1_024
# Classes that a worker remembers to have sent, at most.
SEEN = 500_000

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, U)
    if n:
        out[0] = 1
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the concatenated texts, and the text each word is in."""
    letter = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts[starts < len(data)]] = True
    before = np.concatenate([[False], letter[:-1]])
    first = np.flatnonzero(letter & (~before | cut[:-1]))
    after = np.concatenate([letter[1:], [False]])
    last = np.flatnonzero(letter & (~after | cut[1:])) + 1
    if not len(first):
        return np.empty(0, U), np.empty(0, np.int64)
    # Position within the word, and the byte's weight at that position.
    sizes = last - first
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = (_LOWER[data[letter]].astype(U) + U(1)) * _powers(int(sizes.max()), _BASE)[place]
    sums = np.add.reduceat(value, np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(U)), np.searchsorted(starts, first, "right") - 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Per text its distinct shingles as sorted hashes."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, end = int(starts[0]), int(starts[-1])
    body = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.empty(0, np.uint8)
    hashes, text = _word_hashes(body, starts[:-1] - base)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    weights = mix(np.arange(1, words + 1, dtype=U) * U(_BASE)) | U(1)
    grams = np.zeros(max(len(hashes) - words + 1, 0), U)
    for k in range(words):
        grams += mix(hashes[k : k + len(grams)] + U(k)) * weights[k]
    grams = mix(grams)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield mix((hashes[a:b] * weights[: b - a]).sum(keepdims=True) + U(b - a))
        else:
            yield np.empty(0, U)


def set_id(elements: np.ndarray) -> int:
    parity = np.bitwise_xor.reduce(elements, keepdims=True) + U(len(elements))
    return int((mix(elements ^ U(_BASE)).sum(keepdims=True) + mix(parity)).view(np.int64)[0])


def band(size: int) -> int:
    return (size.bit_length() - 1) // BAND_BITS


def bands(size: int) -> list[int]:
    """The bands in which a set is joined: its own, and the one below if a smaller partner may be there."""
    own = band(size)
    least = -(-size * SHARE[0] // SHARE[1])
    return [own] if band(least) == own else [own, own - 1]


def cells(elements: np.ndarray, of_band: int) -> np.ndarray:
    """The non-empty cells of a set's sketch in a band, as XORs of the hashes they hold."""
    if of_band < WHOLE_BANDS:
        return elements
    bits = (of_band + 1) * BAND_BITS + CELLS_PER_ELEMENT.bit_length() - 1
    # Elements are sorted, so those of one cell (equal leading bits) are neighbours.
    cell = elements >> U(64 - bits)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    held = np.bitwise_xor.reduceat(elements, starts)
    return held[held != 0]


def keys(held: np.ndarray, of_band: int) -> np.ndarray:
    return mix(held + U((of_band + 1) * _BASE % 2**64))


def bit_sketch(elements: np.ndarray) -> bytes:
    """One parity bit per cell, at least two cells per element; a power of two, so that longer sketches fold to shorter."""
    n_bits = max(64, 1 << (2 * len(elements) - 1).bit_length())
    counts = np.bincount((elements & U(n_bits - 1)).astype(np.int64), minlength=n_bits)
    return np.packbits(counts & 1).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits once the longer sketch is folded (XOR of halves) to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def difference_limit(n: int, m: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (n + m) * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])


def chosen(size: int) -> int:
    """Cells of a set of which one must be equal in every linked set: one more than can differ from the largest partner."""
    return difference_limit(size, size * SHARE[1] // SHARE[0]) + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common)


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def describe(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Documents: doc_id, mark, n, set_id, sketch. Counts: slice (not null), counts (16-bit, per task)."""
    token = run_token()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(token, lambda: None)  # frees what an earlier operator left in this worker
        table = np.zeros(1 << COUNT_BITS, np.int64)
        names = ["doc_id", "mark", "n", "set_id", "sketch", "slice", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        some = False
        for batch in batches:
            for part in _slices(batch):
                n, ids, sketches, seen = [], [], [], []
                for elements in shingle_sets(part.column("text")):
                    n.append(len(elements))
                    ids.append(set_id(elements) if len(elements) else None)
                    sketches.append(bit_sketch(elements) if len(elements) else None)
                    if len(elements):
                        seen += [keys(cells(elements, b), b) for b in bands(len(elements))]
                if seen:
                    some = True
                    table += np.bincount((np.concatenate(seen) >> U(64 - COUNT_BITS)).astype(np.int64), minlength=len(table))
                none = pa.nulls(len(n))
                columns = [part.column("doc_id"), part.column("mark"), n, ids, sketches, none, none]
                yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if some:
            parts = np.minimum(table, 65_535).astype("<u2").reshape(-1, COUNT_SLICE)
            none = pa.nulls(len(parts))
            columns = [none, none, none, none, none, list(range(len(parts))), [p.tobytes() for p in parts]]
            yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(described, "doc_id long, mark long, n long, set_id long, sketch binary, slice int, counts binary")


def count_table(described: DataFrame) -> np.ndarray:
    """Per bucket of cells at least as many documents as hold any one cell of it: 2^20 numbers at any size of the input."""

    def summed(kind: str):
        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(c.as_py(), kind).astype(np.int64) for c in table.column("counts"))
            return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()])})

        return add

    # First the tasks of a few, then all: no group holds a row of every task.
    rows = described.where("slice is not null").select("slice", "counts", (F.spark_partition_id() % 64).alias("few"))
    part = rows.groupBy("slice", "few").applyInArrow(summed("<u2"), "slice int, counts binary")
    rows = part.groupBy("slice").applyInArrow(summed("<i4"), "slice int, counts binary")
    out = np.zeros(1 << COUNT_BITS, np.int32)
    for row in rows.collect():
        out[row.slice * COUNT_SLICE : (row.slice + 1) * COUNT_SLICE] = np.frombuffer(row.counts, "<i4")
    return out


def chosen_cells(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, part, set_id): the rarest cells of every class. Cells held by many are dealt into parts of a bounded size (else -1)."""
    token, shared = run_token(), docs.sparkSession.sparkContext.broadcast(counts)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often = worker_cache(token, set), shared.value
        for batch in batches:
            for part in _slices(batch):
                found, owner = [], []
                for elements in shingle_sets(part.column("text")):
                    own = set_id(elements) if len(elements) else None
                    if own is None or own in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(own)
                    for b in bands(len(elements)):
                        held = keys(cells(elements, b), b)
                        order = np.lexsort((held, often[(held >> U(64 - COUNT_BITS)).astype(np.int64)]))[: chosen(len(elements))]
                        found.append(held[order])
                        owner.append(np.full(len(order), own, np.int64))
                if found:
                    key, own = np.concatenate(found), np.concatenate(owner)
                    parts = often[(key >> U(64 - COUNT_BITS)).astype(np.int64)].astype(np.int64) // PART_ROWS + 1
                    salt = np.where(parts > 1, (mix(own.view(U)) % parts.astype(U)).astype(np.int64), -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(own)], ["key", "part", "set_id"])

    return docs.mapInArrow(emitted, "key long, part int, set_id long")


def groups(cells_: DataFrame) -> DataFrame:
    """(group_id, split, hub, set_id): the classes that share a chosen cell, with the smallest of their part.

    Rows arrive sorted, so a part is a run of neighbours and only its hub is remembered. Groups of equal members
    are one group; a cell that was dealt into parts keeps its own group.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
        for batch in batches:
            columns = [np.concatenate([t, batch.column(c).to_numpy()]) for t, c in zip(tail, ("key", "part", "set_id"), strict=True)]
            key, part, _ = columns
            # The last run may go on in the next batch.
            earlier = np.flatnonzero((key != key[-1:]) | (part != part[-1:]))
            done = earlier[-1] + 1 if len(earlier) else 0
            tail = [c[done:] for c in columns]
            yield from _runs(*[c[:done] for c in columns])
        yield from _runs(*tail)

    ordered = cells_.repartition("key", "part").sortWithinPartitions("key", "part", "set_id")
    return ordered.mapInArrow(grouped, "group_id long, split boolean, hub long, set_id long").distinct()


def _runs(key: np.ndarray, part: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    kept = first | np.concatenate([[True], own[1:] != own[:-1]])  # a class may have been sent by several workers
    key, part, own, first = key[kept], part[kept], own[kept], first[kept]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(key)))
    members = np.add.reduceat(mix(own.view(U)), starts)
    spread = lambda per_run: np.repeat(per_run, sizes)
    split = spread(part[starts] >= 0)
    group = np.where(split, mix(key.view(U)), spread(members)).view(np.int64)
    rows = np.unique(np.stack([group, split, spread(own[starts]), own], 1)[split | (spread(sizes) > 1)], axis=0)
    for at in range(0, len(rows), 100_000):
        block = np.ascontiguousarray(rows[at : at + 100_000].T)
        yield pa.RecordBatch.from_arrays([pa.array(block[0]), pa.array(block[1] > 0), pa.array(block[2]), pa.array(block[3])], ["group_id", "split", "hub", "set_id"])


def stars(groups_: DataFrame) -> DataFrame:
    """(a, b): every member of a part with its hub, and the hubs of the parts of one cell with the smallest of them."""
    inside = groups_.select(F.col("hub").alias("a"), F.col("set_id").alias("b"))
    hubs = groups_.where("split").groupBy("group_id", F.col("hub").alias("b")).agg(F.count("*").alias("rows"))
    least = hubs.groupBy("group_id").agg(F.min("b").alias("a"))
    return inside.union(hubs.join(least, "group_id").select("a", "b")).where("a <> b").distinct()


def open_members(groups_: DataFrame, roots: DataFrame) -> DataFrame:
    """(group_id, set_id, root) of the groups whose members are not all connected, three members at least:
    in a group of two, the one pair has been compared."""
    labelled = groups_.select("group_id", "set_id").distinct().join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "set_id"))
    open_ = labelled.groupBy("group_id").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high and size > 2")
    return labelled.join(open_.select("group_id"), "group_id", "left_semi")


def further_stars(groups_: DataFrame) -> DataFrame:
    """(a, b): the members of a group of more than two with ``HUBS`` of them, picked by hashes."""
    members = groups_.select("group_id", "set_id").distinct()
    order = lambda turn: F.struct(F.xxhash64("set_id", F.lit(turn)).alias("h"), F.col("set_id").alias("a"))
    hubs = members.groupBy("group_id").agg(F.count("*").alias("size"), F.array(*[F.min(order(turn)) for turn in range(HUBS)]).alias("hubs"))
    met = members.join(hubs.where("size > 2"), "group_id").select("set_id", F.explode("hubs").alias("hub")).where("set_id <> hub.a")
    return met.select(F.least("hub.a", "set_id").alias("a"), F.greatest("hub.a", "set_id").alias("b")).distinct()


def unconnected(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): members of one group that no link connects so far and whose sizes and sketches allow one.

    Groups with the same largest component are taken together, as they share most members. Members outside that component
    are compared with all others, by blocks and by sketches alone; only pairs that pass leave the task.
    """
    counts = members.groupBy("group_id", "root").agg(F.count("*").alias("n_root"))
    most = counts.groupBy("group_id").agg(F.max(F.struct("n_root", "root")).alias("most")).select("group_id", F.col("most.root").alias("main"))
    gathered = members.join(most, "group_id").select("main", "set_id", "root").distinct().checkpoint()
    blocks = gathered.groupBy("main").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = gathered.join(blocks, "main").join(classes.select("set_id", "n", "sketch"), "set_id").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    # A member answers in the pieces of all probes and, outside the largest component, asks in those of all blocks.
    every, own = F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")
    piece = lambda probe, block, asks: F.struct(probe.alias("probe"), block.alias("block"), F.lit(asks).alias("asks"))
    answers = F.transform(every, lambda k: piece(k, own, False))
    asked = F.transform(F.filter(every, lambda _: F.col("root") != F.col("main")), lambda k: piece(own, k, True))
    work = placed.select("main", "set_id", "root", "n", "sketch", F.inline(F.concat(answers, asked)))
    work = work.repartition("main", "probe", "block").sortWithinPartitions("main", "probe", "block")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            keys_ = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("main", "probe", "block")], 1)
            starts = np.flatnonzero(np.concatenate([[True], (keys_[1:] != keys_[:-1]).any(1)])) if len(keys_) else np.array([0])
            for a, b in zip(starts[:-1], starts[1:]):
                yield from _passing(rows.slice(a, b - a))
            tail = rows.slice(starts[-1])
        if tail is not None and tail.num_rows:
            yield from _passing(tail)

    return work.mapInArrow(compared, "a long, b long").distinct()


def _passing(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    own, root, n, asks = (rows.column(c).to_numpy() for c in ("set_id", "root", "n", "asks"))
    sketch = rows.column("sketch").to_pylist()
    others = np.flatnonzero(~asks)
    folded: dict[tuple[int, int], np.ndarray] = {}
    lengths = np.array([len(sketch[k]) for k in others])
    found_a, found_b = [], []
    for k in np.flatnonzero(asks):
        mine = np.frombuffer(sketch[k], np.uint8)
        for length in np.unique(lengths):
            some = others[lengths == length]
            short = min(int(length), len(mine))
            if (length, short) not in folded:
                folded[length, short] = _fold(np.frombuffer(b"".join(sketch[j] for j in some), np.uint8).reshape(len(some), -1), short)
            apart = np.bitwise_count(folded[length, short] ^ _fold(mine[None], short)).sum(1, dtype=np.int64)
            limit = (n[some] + n[k]) * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])
            sizes = SHARE[1] * np.minimum(n[some], n[k]) >= SHARE[0] * np.maximum(n[some], n[k])
            hit = some[(apart <= limit) & sizes & (root[some] != root[k])]
            found_a.append(np.minimum(own[hit], own[k]))
            found_b.append(np.maximum(own[hit], own[k]))
    if found_a:
        pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], 1), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p)) for p in pairs], ["a", "b"])


def _fold(sketches: np.ndarray, length: int) -> np.ndarray:
    while sketches.shape[1] > length:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def marked_only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of all ``docs`` whose id is in ``wanted``, and few others: texts that nobody asks for are not shuffled.

    The marks are bits at the ids' hashes, 4 MB at any number of ids, so they are broadcast.
    """
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    part, bit = F.shiftright(place, MARK_ROW_BITS), place.bitwiseAND(F.lit((1 << MARK_ROW_BITS) - 1))
    marks = wanted.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    placed = docs.select("doc_id", "text", part.alias("part"), bit.alias("bit")).join(F.broadcast(marks), "part")
    return placed.where(F.getbit(byte, F.col("bit").bitwiseAND(F.lit(7)).cast("int")) == 1).select("doc_id", "text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link. Sizes and sketches reject most others before any set is fetched."""
    ensure_checkpoint_dir(docs.sparkSession)
    both = pairs
    for side in "ab":
        both = both.join(classes.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}")), side)
    both = both.where(SHARE[1] * F.least("n_a", "n_b") >= SHARE[0] * F.greatest("n_a", "n_b"))
    for side in "ab":
        both = both.join(classes.select(F.col("set_id").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")]
            kept = [hamming(x, y) <= difference_limit(n, m) for n, m, x, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = both.mapInArrow(possible, "a long, b long").checkpoint()
    wanted = left.select(F.col("a").alias("set_id")).union(left.select("b")).distinct().join(classes.select("set_id", "doc_id"), "set_id")
    wanted = wanted.checkpoint()
    texts = marked_only(docs, wanted).alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.set_id", "d.text")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 200):
                ids, sets = part.column("set_id").to_pylist(), list(shingle_sets(part.column("text")))
                own = [(i, e.tobytes()) for i, e in zip(ids, sets, strict=True) if len(e) and set_id(e) == i]  # an id may be repeated
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([e for _, e in own], pa.binary())], ["set_id", "elements"])

    sets = texts.mapInArrow(elements, "set_id long, elements binary").dropDuplicates(["set_id"])
    for side in "ab":
        left = left.join(sets.select(F.col("set_id").alias(side), F.col("elements").alias(f"elements_{side}")), side)

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("elements_a"), batch.column("elements_b"), strict=True)
            kept = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return left.mapInArrow(linking, "a long, b long")


def further_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(root, least) of the roots that more ``links`` (a, b) tie to each other: what ``roots`` has joined is not linked again."""
    ties = links
    for side in "ab":
        ties = ties.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    tied = components(ties.select(*[F.coalesce(f"root_{side}", side).alias(side) for side in "ab"]))
    return tied.select(F.col("node").alias("root"), F.col("root").alias("least"))


def _rooted(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text, mark): their (doc_id, mark, n, set_id), and the classes (set_id, doc_id, copies, root)."""
    ensure_checkpoint_dir(read.sparkSession)
    bound_batches(read.sparkSession)
    described = describe(read).checkpoint()
    counts = count_table(described)
    rows = described.where("slice is null").select("doc_id", "mark", "n", "set_id", "sketch")
    classes = rows.where("set_id is not null").groupBy("set_id", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")).checkpoint()
    met = groups(chosen_cells(read, counts)).checkpoint()
    links = verified(stars(met).union(further_stars(met)).distinct(), classes, read).checkpoint()
    roots = components(links)
    # Written out before it is used several times: else each use brings its whole plan along, and the driver plans and starts all of them.
    open_ = open_members(met, roots).checkpoint()
    rest = verified(unconnected(open_, classes), classes, read)
    named = classes.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = named.join(further_roots(roots, rest), "root", "left").withColumn("root", F.coalesce("least", "root"))
    return rows.drop("sketch"), named.select("set_id", "doc_id", "copies", "root")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, copies) of every row: the component's id is the smallest document id that links
    reach, ``copies`` the number of rows with the same set. Texts without words have no set: they are their own component."""
    rows, named = _rooted(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.lit(None).cast("long").alias("mark")))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(smallest, "root").select("set_id", "component_id", "copies")
    placed = rows.join(of_class, "set_id", "left")
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest id (rows without id come last), then the smallest hash of the row.

    Rows are named by a 64-bit hash of the whole row, so one id with two texts keeps both unless they link, and of
    equal rows one stays. Rows without words link with nothing and all stay.
    """
    mark = unused("row_hash", docs.columns)
    marked = docs.withColumn(mark, row_hash(docs))
    rows, named = _rooted(marked.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(mark).alias("mark")))
    names = rows.where("n > 0").groupBy("set_id", "doc_id", "mark").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "rows")
    # Least of a class first, so that the join with the classes meets one row of each.
    least = names.groupBy("set_id").agg(F.min(order).alias("least")).join(named.select("set_id", "root"), "set_id")
    stays = least.groupBy("root").agg(F.min("least").alias("least")).select("least.mark", "least.rows").checkpoint()
    gone = names.select("mark").join(stays.select("mark"), "mark", "left_anti")
    repeated = stays.where("rows > 1").select(F.col("mark").alias(mark))
    apart = gone.select(F.col("mark").alias(mark)).union(repeated).distinct()
    once = marked.join(repeated, mark, "left_semi").dropDuplicates([mark])
    return marked.join(apart, mark, "left_anti").unionByName(once).drop(mark)
