"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text is cut by the vocabulary's pattern into words. Distinct words not met before become token-position rows
(word, position, token), first one row per byte. A recursive query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of lowest rank, until no pair is left. Decoding joins ids with the vocabulary and
concatenates the bytes of a run of ids by an aggregate ordered by position.

The engine is a helper of a task: its rows are the new words of one slice of one partition, its memory is capped, and
what it found is kept, bounded, for the worker's next slices.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded each; very long
words cost one round per merge, of that word alone. Extra columns stay inside ``row``.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Memory, packed, run_token, travels, worker_cache

travels(__name__)

# Entries per generation of each of a worker's stores, words per recursive query, and the engine's memory.
CACHED = 250_000
QUERY_WORDS = 40_000
ENGINE_MB = 250

MERGE_SQL = """
with recursive step as (
    select word, list(token order by pos) as tokens, false as done from symbols group by word
  union all (
    with positions as (
        select word, tokens, unnest(generate_series(1, len(tokens) - 1)) as pos from step where not done),
    best as (
        -- a merged token's id is its rank: the lowest id is the lowest rank, the lowest position the leftmost pair
        select p.word, min((m.merged::bigint << 32) | p.pos) as choice
        from positions p join merges m on m.left_token = p.tokens[p.pos] and m.right_token = p.tokens[p.pos + 1]
        group by p.word)
    select s.word,
           case when b.choice is null then s.tokens
                else s.tokens[:(b.choice & 4294967295) - 1] || [(b.choice >> 32)::int] || s.tokens[(b.choice & 4294967295) + 2:] end,
           b.choice is null
    from step s left join best b using (word) where not s.done))
select word, tokens from step where done order by word
"""

DECODE_SQL = """
select s.run, string_agg(v.bytes, '' order by s.pos) as text
from spans s join vocabulary v on v.token = s.token group by s.run order by s.run
"""

# White space that str.split(" ") leaves inside its parts; next to a space it changes how words are cut.
COMMON_BLANKS = "\t\n\r"
RARE_ASCII_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f"
OTHER_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# New pieces decoded as one run.
RUN_PIECES = 64


def plainly_spaced(text: str) -> bool:
    """Whether every space stands alone between two characters that are no white space."""
    if text[0].isspace() or text[-1].isspace() or "  " in text or any(f" {c}" in text or f"{c} " in text for c in COMMON_BLANKS):
        return False
    return not any(c in text for c in RARE_ASCII_BLANKS) and (text.isascii() or not any(c in text for c in OTHER_BLANKS))


class Codec:
    """Encodes and decodes with one rank file; stores of one worker for one run."""

    def __init__(self, rank_path: str, pattern: str):
        import duckdb
        import regex

        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.apart = regex.compile(r"(?<=\S) (?=\S)").split
        self.words = Memory(CACHED, self._learn)
        self.heads = Memory(CACHED, lambda chunks: self._join(chunks, ""))
        self.tails = Memory(CACHED, lambda chunks: self._join(chunks, " "))
        self.engine = duckdb.connect(config={"threads": 1, "memory_limit": f"{ENGINE_MB}MB"})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        columns = [pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)]
        self._table("merges", pa.table(columns, ["left_token", "right_token", "merged"]))
        # Bytes as characters of the same number, which the engine can concatenate as text.
        self._table("vocabulary", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]}))
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = list(map(len, self.ranks))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.engine.register("given", rows)
        self.engine.execute(f"create table {name} as from given")
        self.engine.unregister("given")

    def _pieces(self, text: str) -> list[str]:
        """The parts between lone spaces; no word of the pattern spans such a place, and the space belongs to what
        follows, so the parts can be matched one by one."""
        return text.split(" ") if plainly_spaced(text) else self.apart(text)

    def parts(self, texts: list[str | None]) -> list[list[tuple[bytes, bytes]]]:
        """Per text its successive parts as (ids as little-endian 32-bit numbers, the bytes these ids decode to)."""
        split = [self._pieces(t) if t else [] for t in texts]
        first = iter(self.heads.get([p[0] for p in split if p]))
        rest = iter(self.tails.get([c for p in split for c in p[1:]]))
        return [[next(first), *itertools.islice(rest, len(p) - 1)] if p else [] for p in split]

    def _join(self, chunks: list[str], before: str) -> Iterator[tuple[str, tuple[bytes, bytes]]]:
        """Parts from their words. Letters alone, with the space before them, are one word of the pattern."""
        cut = [[before + c] if c.isalpha() else self.find(before + c) for c in chunks]
        known = iter(self.words.get(list(itertools.chain.from_iterable(cut))))
        for chunk, words in zip(chunks, cut, strict=True):
            if len(words) == 1:
                yield chunk, next(known)
            else:
                ids, decoded = zip(*itertools.islice(known, len(words)), strict=True)
                yield chunk, (b"".join(ids), b"".join(decoded))

    def _learn(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes]]]:
        ids = {w: self.ranks[b].to_bytes(4, "little") for w in words if (b := w.encode()) in self.ranks}  # a whole word needs no merges
        rest = [w for w in words if w not in ids]
        for at in range(0, len(rest), QUERY_WORDS):
            some = rest[at : at + QUERY_WORDS]
            spelled = [w.encode() for w in some]
            sizes = np.array([len(b) for b in spelled])
            word = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            symbols = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            self.engine.register("symbols", pa.table({"word": word, "pos": pos.astype(np.int32), "token": symbols}))
            out = self.engine.sql(MERGE_SQL).to_arrow_table().column("tokens").combine_chunks()
            self.engine.unregister("symbols")
            flat, cuts = out.values.to_numpy().astype("<u4").tobytes(), 4 * out.offsets.to_numpy()
            ids.update((w, flat[a:b]) for w, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return zip(ids, zip(ids.values(), self.decode(list(ids.values())), strict=True), strict=True)

    def decode(self, runs: list[bytes]) -> list[bytes]:
        """The bytes that each run of ids stands for. Several runs are decoded at once and cut at their lengths."""
        out = []
        for at in range(0, len(runs), QUERY_WORDS):
            some = runs[at : at + QUERY_WORDS]
            token = np.frombuffer(b"".join(some), "<u4").astype(np.int32)
            counts = np.array([len(r) // 4 for r in some])
            run = np.repeat(np.arange(len(some), dtype=np.int32) // RUN_PIECES, counts)
            self.engine.register("spans", pa.table({"run": run, "pos": np.arange(len(token), dtype=np.int32), "token": token}))
            decoded = "".join(t for _, t in self.engine.execute(DECODE_SQL).fetchall()).encode("latin-1")
            self.engine.unregister("spans")
            ends = np.concatenate([[0], np.cumsum(self.sizes[token])])[np.cumsum(counts)].tolist()
            out += [decoded[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        return out


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``row`` and ``ids`` (array of int) of every text."""
    token = run_token()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(token, lambda: Codec(rank_path, pattern))
        for batch in batches:
            for part in _slices(batch):
                runs = [b"".join(ids for ids, _ in parts) for parts in codec.parts(part.column("text").to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in runs])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(runs), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("row"), ids], ["row", "ids"])

    rows = packed(docs, text=text)
    return rows.mapInArrow(encoded, rows.select("row", F.array().cast("array<int>").alias("ids")).schema)


def decode(encoded: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``row`` (the whole input row) and ``bytes`` that the ids stand for; none for null."""
    token = run_token()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(token, lambda: Codec(rank_path, pattern))
        for batch in batches:
            for part in _slices(batch, 100):
                runs = [np.array(v or [], "<u4").tobytes() for v in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(codec.decode(runs), pa.binary())], ["row", "bytes"])

    rows = packed(encoded, ids=ids)
    return rows.mapInArrow(decoded, rows.select("row", F.lit(b"").alias("bytes")).schema)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``row``, ``ids`` (decimal, joined by one space) and ``bytes`` decoded from the ids, in one pass over the texts.

    Words that repeat are encoded, and their ids decoded, once while a worker remembers them.
    """
    token = run_token()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(token, lambda: Codec(rank_path, pattern))
        decimal = list(map(str, range(len(codec.sizes)))).__getitem__
        for batch in batches:
            for part in _slices(batch):
                ids, back = [], []
                for parts in codec.parts(part.column("text").to_pylist()):
                    run = np.frombuffer(b"".join([p[0] for p in parts]), "<u4")
                    ids.append(" ".join(map(decimal, run.tolist())))
                    back.append(b"".join([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.string()), pa.array(back, pa.binary())], ["row", "ids", "bytes"])

    rows = packed(docs, text=text)
    return rows.mapInArrow(both, rows.select("row", F.lit("").alias("ids"), F.lit(b"").alias("bytes")).schema)
