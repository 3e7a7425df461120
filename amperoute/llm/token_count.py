"""Token counts by a linear longest-match automaton over a public byte vocabulary.

Words are runs of anything but ASCII white space, taken with one leading space; a word's pieces are the greedy
longest matches from its left end. The vocabulary becomes a trie; each node has a failure link and the number of
pieces that are complete once the link is taken, so a word is counted in one pass and no piece is ever built.

Defined results: null, empty and blank texts count 0; repeated rows are counted each. Every byte is a piece of
the vocabulary, so every text has a count. Extra columns stay inside ``row``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import Memory, packed, run_token, travels, worker_cache

travels(__name__)

# Counts of words that a worker keeps, per generation.
CACHED_WORDS = 400_000


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Automaton:
    """``goto[node * 256 + byte]`` is the trie; ``fail`` and ``popped`` belong to the nodes; node 0 is the root."""

    def __init__(self, pieces):
        self.goto: dict[int, int] = {}
        self.fail, self.popped = [-1], [0]
        final, children = [False], [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                to = self.goto.get(node << 8 | byte)
                if to is None:
                    to = self.goto[node << 8 | byte] = len(final)
                    final.append(False)
                    children.append([])
                    children[node].append((byte, to))
                node = to
            final[node] = node > 0
        self.fail += [-1] * (len(final) - 1)
        self.popped += [0] * (len(final) - 1)
        level = [0]
        while level:
            deeper = []
            for above in level:
                for byte, node in children[above]:
                    self._link(above, byte, node, final[node])
                    deeper.append(node)
            level = deeper

    def _link(self, above: int, byte: int, node: int, is_piece: bool) -> None:
        if is_piece:
            self.fail[node], self.popped[node] = 0, 1
            return
        count, z = self.popped[above], self.fail[above]
        while z >= 0 and z << 8 | byte not in self.goto:
            count, z = count + self.popped[z], self.fail[z]
        self.fail[node], self.popped[node] = (self.goto[z << 8 | byte] if z >= 0 else -1), count

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split; ValueError if the vocabulary cannot spell the word."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for byte in word:
            to = goto.get(node << 8 | byte)
            while to is None:
                if fail[node] < 0:
                    raise ValueError(f"no piece spells {word!r}")
                total += popped[node]
                node = fail[node]
                to = goto.get(node << 8 | byte)
            node = to
        while node:
            if fail[node] < 0:
                raise ValueError(f"no piece spells {word!r}")
            total += popped[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``row``, n_words and n_tokens of every row. ``vocabulary``: path of a rank file every worker can read."""
    token = run_token()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Memory:
            automaton = Automaton(rank_file(vocabulary))
            return Memory(CACHED_WORDS, lambda words: [(w, automaton.count(b" " + w)) for w in words])

        known = worker_cache(token, made)
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column("text"):
                words = (value.as_py() or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(sum(known.get(words)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["row", "n_words", "n_tokens"])

    rows = packed(docs, text=text)
    out = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(counted, out)


def tokens_by(counted: DataFrame, *keys: str) -> DataFrame:
    """Documents, words and tokens per group of row columns; a hot group leaves each task as one row."""
    return counted.groupBy(*[F.col(f"row.{k}") for k in keys]).agg(F.count("*").alias("docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
