"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text compete for every window.

Two dictionaries are trained. The ordinary one comes from the distinct words of ordinary documents, the toxic one from those
words of toxic documents that are over-represented there. Both end with the ordinary content, so that what ordinary text
explains costs the same under both. A window is one run of letters, lower-cased, between a head and a tail that no
dictionary knows (a compressor starts no match in the last bytes of its input). Its distance is the length compressed
with the ordinary dictionary minus that compressed with the toxic one.

The distances' thresholds are calibrated: per window length and distance, the log ratio of its frequency in toxic and in
ordinary documents, counted on documents whose dictionaries were trained without them (two folds). A document's score is a
logistic function of how many windows exceed which ratio, fitted on the same folds.

The model is fitted on at most ``TRAIN_TOXIC`` toxic and ``TRAIN_ORDINARY`` ordinary labelled documents of at most
``TRAIN_CHARS`` characters, chosen by a hash of their row; every document is scored, over its whole text.

Defined results: null and empty texts, and texts without letters, have no window and get the score the model gives to that;
rows that repeat are scored each; a document whose label is null is unlabelled, one with several labels is toxic if one says
so. Without labelled documents of both classes every score is the labelled toxic share (0 without labels). A row without an
id is held out. Windows of any length are compressed whole. Extra columns stay inside ``row``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Memory, packed, run_token, travels, worker_cache

travels(__name__)

# Bounds of the labelled sample that the driver fits on: at most 8,000 texts, some 20 MB at usual lengths.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_CHARS = 2_000, 6_000, 50_000
# Dictionary bytes; a toxic word occurs in so many documents and is so many times as frequent as in ordinary ones.
TOXIC_BYTES, ORDINARY_BYTES = 8192, 1024
LEAST_DOCUMENTS, LEAST_RATIO = 4, 5
# Segment and d-mer length of the dictionary trainer, level and shortest match of the compressor.
SEGMENT, DMER, LEVEL, SHORTEST_MATCH = 24, 6, 9, 4
# What stands around a window, unlike anything in a text.
HEAD, TAIL = bytes(range(1, 17)) + b" ", b" " + bytes(range(128, 140))
# Longer windows share one calibrated length.
LONGEST = 16
# Ratios whose exceeding windows are counted, and whose share is taken.
COUNTED, SHARED = (0.5, 1, 1.5, 2.5, 4), (0.5, 1, 2)
RIDGE, STEPS = 1.0, 50
# Windows a worker remembers per generation.
REMEMBERED = 400_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def windows(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"[^\W\d_]+", text.lower()) if text else []


def _trained(samples: list[bytes], size: int) -> bytes:
    """Dictionary content; where the trainer finds too little text, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _sample(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


class Distance:
    """Compressed lengths of a window under both dictionaries. Travels as bytes; compressors are made where it is used."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.contents = (ordinary, toxic + ordinary)
        self.compressors = None

    def __getstate__(self):
        return {"contents": self.contents, "compressors": None}

    def __call__(self, window: str) -> int:
        if self.compressors is None:
            self.compressors = [self._compressor(c) for c in self.contents]
        framed = HEAD + window.encode("utf-8", "replace") + TAIL
        return len(self.compressors[0].compress(framed)) - len(self.compressors[1].compress(framed))

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        plain = {"min_match": SHORTEST_MATCH, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), **plain)
        known = zstandard.ZstdCompressionDict(content + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)

    @staticmethod
    def train(documents: list[tuple[list[str], int]]) -> Distance:
        """From (distinct windows, toxic) of documents of both classes."""
        found, of = [Counter(), Counter()], Counter(label for _, label in documents)
        for words, label in documents:
            found[label].update(words)
        enough = lambda w, n: n >= LEAST_DOCUMENTS and n / of[1] > LEAST_RATIO * (found[0][w] + 0.5) / of[0]
        own = {w for w, n in found[1].items() if enough(w, n)}
        toxic = [_sample(kept) for words, label in documents if label and (kept := [w for w in words if w in own])]
        ordinary = [_sample(words) for words, label in documents if not label and words]
        return Distance(_trained(toxic, TOXIC_BYTES), _trained(ordinary, ORDINARY_BYTES))


def _bin(window: str, distance: int) -> tuple[int, int]:
    return min(len(window.encode("utf-8", "replace")), LONGEST), distance


def _features(ratios: list[float]) -> list[float]:
    r = np.array(ratios or [0.0])
    return [1.0, r.max(), r.mean(), math.log(len(r)), *[math.log1p((r > t).sum()) for t in COUNTED], *[(r > t).mean() for t in SHARED]]


class Model:
    """Dictionaries, calibrated ratios and the logistic function of a document's windows."""

    def __init__(self, documents: list[tuple[list[str], int]]):
        """From (windows, toxic) of documents, in an order that does not depend on how Spark dealt them."""
        self.base = sum(label for _, label in documents) / max(1, len(documents))
        distinct = [(sorted(set(words)), label) for words, label in documents]
        halves = [[k for label in (0, 1) for k in [i for i, d in enumerate(documents) if d[1] == label][part::2]] for part in (0, 1)]
        self.distance = None
        if any({documents[k][1] for k in half} != {0, 1} for half in halves):
            return
        folds = [Distance.train([distinct[k] for k in half]) for half in halves]
        counts, far = [Counter(), Counter()], {}
        for fold, half in zip(folds, reversed(halves), strict=True):
            bins = {w: _bin(w, fold(w)) for w in sorted({w for k in half for w in distinct[k][0]})}
            for k in half:
                words, label = distinct[k]
                far[k] = bins
                counts[label].update(map(bins.__getitem__, words))
        totals = [c.total() + 1 for c in counts]
        rate = lambda b, y: (counts[y][b] + 0.5) / totals[y]
        self.ratios = {b: math.log(rate(b, 1) / rate(b, 0)) for b in {*counts[0], *counts[1]}}
        rows = np.array([_features([self.ratios[far[k][w]] for w in words]) for k, (words, _) in enumerate(documents)])
        self.centre, self.spread = rows.mean(0), rows.std(0) + 1e-9
        self.centre[0], self.spread[0] = 0, 1
        self.weights = self._fit((rows - self.centre) / self.spread, np.array([float(label) for _, label in documents]))
        self.distance = Distance.train(distinct)

    @staticmethod
    def _fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Ridge logistic regression by Newton steps."""
        weights = np.zeros(rows.shape[1])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
            curve = (rows * (p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(len(weights))
            weights = weights + np.linalg.solve(curve, rows.T @ (labels - p) - RIDGE * weights)
        return weights

    def learned(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """Each window with its ratio; 0 for a length and distance that no labelled document shows."""
        return ((w, self.ratios.get(_bin(w, self.distance(w)), 0.0)) for w in words)

    def score(self, ratios: list[float]) -> float:
        at = (np.array(_features(ratios)) - self.centre) / self.spread @ self.weights
        return float(1 / (1 + math.exp(-min(max(at, -30), 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out. Starts a job; a bounded sample reaches the driver."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    dealt = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("deal"))
    short = dealt.where(~held_out(F.col("doc_id")) & (F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS))
    known = short.select("doc_id", "deal").join(marked, "doc_id").select("deal", "label").distinct()
    # Numbers alone are ordered; the few texts that they choose follow.
    drawn = [known.where(f"label = {label}").orderBy("deal").limit(n) for label, n in ((0, TRAIN_ORDINARY), (1, TRAIN_TOXIC))]
    chosen = {row.deal: row.label for part in drawn for row in part.collect()}
    picked = docs.sparkSession.createDataFrame(list(chosen), "long").toDF("deal")
    texts = dealt.join(F.broadcast(picked), "deal", "left_semi").select("deal", "text").dropDuplicates(["deal"]).collect()
    rows = sorted((row.deal, row.text) for row in texts)
    return Model([(windows(text), chosen[deal]) for deal, text in rows])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row``, ``held_out`` and ``score`` (0 to 1) of every document; reads ``doc_id`` and ``text``."""
    model, token = fit(docs, labels), run_token()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_cache(token, lambda: Memory(REMEMBERED, model.learned))
        for batch in batches:
            if model.distance is None:
                scores = [model.base] * batch.num_rows
            else:
                scores = [model.score(memory.get(windows(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("out"), pa.array(scores, pa.float64())], ["row", "held_out", "score"])

    rows = packed(docs, text="text", doc_id="doc_id").select("row", "text", held_out(F.col("doc_id")).alias("out"))
    return rows.mapInArrow(scored, rows.select("row", F.col("out").alias("held_out"), F.lit(0.0).alias("score")).schema)
