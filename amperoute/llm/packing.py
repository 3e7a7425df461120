"""Hierarchical multi-length packing of tokenised documents.

Each document's ids are cut into full windows of the longest context; what remains is routed to the shortest tier
that holds it. Tiers are packed from the longest down: every window is closed with rests from shorter tiers, whole
where one fits best and cut where none does. What no window takes is cut at powers of two, which need no padding.
Windows are then dealt to step groups so that the groups' token counts are balanced.

Documents are packed in groups of bounded size inside the task that reads them, so nothing is shuffled.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a null id is kept; a text
longer than a group is a group of its own. Extra columns play no part.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from .rows import Memory, run_token, travels, worker_cache

travels(__name__)

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
# Ids that one packing group gathers, and ids of a training step.
GROUP_IDS = 1 << 21
STEP_IDS = 1 << 18
CACHED_WORDS = 500_000  # per generation
ID_BYTES = 4


# A word of Latin letters that the tokenizer cuts into one run of letters and at most one run of signs behind it.
LETTERS_SIGNS = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)"
END_OF_RUN = "</w>"


class WordIds:
    """Little-endian 32-bit ids of texts. No token of the vocabulary spans white space, so words are encoded alone and kept.

    New words of Latin letters and signs are put together from their runs, which are kept too: many words share them.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parted = re.compile(LETTERS_SIGNS).fullmatch
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END_OF_RUN)]
        self.ends = np.zeros(max(ends) + 2, bool)
        self.ends[ends] = True
        self.known = Memory(limit, self._learn)
        self.runs = Memory(limit, self._learn_runs)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        ids = iter(self.known.get([w for words in split for w in words]))
        return [b"".join(itertools.islice(ids, len(words))) for words in split]

    def _learn(self, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        runs, whole, parts = [], [], []
        for word in new:
            found = self.parted(word.decode())
            if found is None:
                whole.append(word)
                parts.append(0)
                continue
            letters, signs = found.groups()
            runs.append(letters.lower())
            if signs:
                runs.append(signs)
            parts.append(2 if signs else 1)
        run, other = iter(self.runs.get(runs)), iter(self._learn_whole(whole))
        for word, n in zip(new, parts, strict=True):
            yield word, next(run) if n == 1 else next(run) + next(run) if n else next(other)

    def _learn_runs(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each run ends with its only token that carries the vocabulary's mark of an end, so ids need no offsets."""
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            found = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(found, "<u4")
            cuts = ((np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * ID_BYTES).tolist()
            flat = ids.tobytes()
            if len(cuts) == len(some) and cuts[-1] == len(flat):
                yield from zip(some, [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts)], strict=True)
            else:  # another vocabulary without such marks
                yield from zip(some, self._learn_whole([r.encode() for r in some]), strict=True)

    def _learn_whole(self, new: list[bytes]) -> Iterator[bytes]:
        """One call for many words, joined by spaces: an id belongs to the word in which its token starts."""
        for at in range(0, len(new), 2000):
            words = [w.decode() for w in new[at : at + 2000]]
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            cuts = (np.searchsorted(starts, ends) * ID_BYTES).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            yield from [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); every id of every document is in exactly one piece.

    All windows have the length of a tier or another power of two, so none is padded.
    """
    longest, windows = tiers[0], []
    rests: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for doc, n in enumerate(lengths):
        full = n - n % longest
        windows += [[(doc, at, longest)] for at in range(0, full, longest)]
        if rest := n - full:
            rests[min(t for t in tiers if t >= rest)].append((rest, doc, full))
    pool = sorted(x for t in tiers[1:] for x in rests[t])  # (length, document, start), shorter tiers' rests first
    for place, tier in enumerate(tiers):
        own = rests[tier] if place == 0 else [x for x in pool if x[0] * 2 > tier or place == len(tiers) - 1]
        shorter = pool if place == 0 else pool[: len(pool) - len(own)]
        windows_of_tier, pool = _fill(sorted(own, reverse=True), shorter, tier)
        windows += windows_of_tier
    for length, doc, start in pool:
        while length:
            part = 1 << (length.bit_length() - 1)
            windows.append([(doc, start, part)])
            start, length = start + part, length - part
    return windows


def _fill(own: list[tuple[int, int, int]], shorter: list[tuple[int, int, int]], tier: int):
    """Windows of one tier: each of ``own`` opens one, and rests of ``shorter`` (ascending) close it; when those run
    out, the tier's own smallest rests are cut up. Returns the windows and what is left, ascending."""
    windows, pool = [], shorter
    own = own[::-1]  # ascending: the largest is taken from the end, the smallest is cut up first
    while own:
        length, doc, start = own.pop()
        while length > tier:  # left over by a longer tier
            windows.append([(doc, start, tier)])
            start, length = start + tier, length - tier
        pieces, gap = [(doc, start, length)], tier - length
        while gap:
            source = pool if pool else own
            if not source:
                break
            at = bisect.bisect_right(source, (gap, float("inf"), 0)) - 1
            if at >= 0:
                n, d, s = source.pop(at)
                pieces.append((d, s, n))
                gap -= n
            else:
                n, d, s = source.pop(0)
                pieces.append((d, s, gap))
                bisect.insort(source, (n - gap, d, s + gap))
                gap = 0
        if gap:
            pool = sorted(pool + [(n, d, s) for d, s, n in pieces])
            break
        windows.append(pieces)
    return windows, pool


def steps(windows: list[list[tuple[int, int, int]]], step_ids: int = STEP_IDS) -> list[int]:
    """The step group of each window: longest windows first, each to the group with the fewest ids so far."""
    sizes = [sum(n for _, _, n in w) for w in windows]
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_ids)))]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -sizes[k]):
        ids, group = groups[0]
        out[k] = group
        heapq.heapreplace(groups, (ids + sizes[k], group))
    return out


PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_id", pa.int64()),
])


def pack(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, window, step_id.

    ``sequence_id`` and ``step_id`` count within the partition that read the documents, below its number.
    """
    bound_batches(docs.sparkSession)
    token = run_token()

    def packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(token, lambda: WordIds(vocabulary, cached_words))
        first = TaskContext.get().partitionId() << 40
        end = END_ID.to_bytes(ID_BYTES, "little")
        next_sequence = next_step = first
        group, size = [], 0
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(keys), 500):
                ids = words.encode(texts[at : at + 500].to_pylist())
                for doc, own in zip(keys[at : at + 500], ids, strict=True):
                    group.append((doc, own + end))
                    size += len(own) // ID_BYTES + 1
                    if size >= GROUP_IDS:
                        out, next_sequence, next_step = _packed_group(group, tiers, next_sequence, next_step)
                        yield out
                        group, size = [], 0
        if group:
            yield _packed_group(group, tiers, next_sequence, next_step)[0]

    read = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_id long"
    return read.mapInArrow(packed_batches, kinds)


def _packed_group(group: list[tuple[int | None, bytes]], tiers: tuple[int, ...], sequence: int, step: int):
    lengths = [len(ids) // ID_BYTES for _, ids in group]
    windows = plan(lengths, tiers)
    dealt = steps(windows)
    columns: list[list] = [[] for _ in PIECE]
    for k, window in enumerate(windows):
        offset, size = 0, sum(n for _, _, n in window)
        for doc, start, n in window:
            key, ids = group[doc]
            row = (key, start, n, ids[start * ID_BYTES : (start + n) * ID_BYTES], lengths[doc], sequence + k, offset, size, step + dealt[k])
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += n
    arrays = [pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=PIECE), sequence + len(windows), step + max(dealt) + 1
