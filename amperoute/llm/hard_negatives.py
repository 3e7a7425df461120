"""Hard negatives by cover trees: best-first descent under inner-product bounds, exact for integer vectors.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), which gives all candidates the norm M; a query
gets 0 there. A cover tree halves its covering radius level by level: every node keeps the largest distance from its centre
to anything below it, so a query's distance to the centre bounds the inner products below from both sides. A descent
takes the node with the highest bound first, leaves out nodes outside the window of scores that is asked for (or without a
label that is asked for), and verifies single points and leaves exactly.

Spark deals the work. Rows equal in vector and label are one point, which keeps as many of its smallest ids as an answer
can hold: no copy beyond those can be in any answer. Points fall into cells around pivots (at most ``PIVOTS``, from a
hash-ordered sample), cells into pages of about ``PAGE_POINTS``, each with a tree of its own. Anchors of one point ask
once. Positives are searched in the pages of the anchor's own cell first; what is found there is the lower bound under
which all other pages are left out by their root, before any tree is shipped. Negatives are searched in the window of
scores that each positive opens.

Defined results: rows with a null id, label or vector, or with a null component, take no part; vectors of different length
have no inner product and never meet; empty vectors have the inner product 0. Rows that agree in id, label and vector
count once; a row never is the partner of a row with its own id. Scores are exact as long as they fit a long. Ties go to
the smaller id. Empty tables give no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ensure_checkpoint_dir
from .rows import travels

travels(__name__)

PIVOTS, PAGE_POINTS, LEAF_POINTS = 256, 2048, 16
# Queries that meet one tree in one group.
GROUP_QUERIES = 4096
# Products below this are exact in double precision.
EXACT = 2.0**53


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer vector."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    return (x.astype(float) @ q.astype(float)).astype(np.int64) if most < EXACT else x @ q


@dataclass
class CoverTree:
    """Nodes are numbered from the root, 0; a node's children, or a leaf's points, are one slice of ``below``."""

    x: np.ndarray  # points, integer
    floats: np.ndarray | None  # the same as doubles, where products are exact in them
    most: float  # the largest absolute component
    labels: np.ndarray
    ids: list[list[int]]
    norm: float  # M^2
    centre: np.ndarray
    radius: np.ndarray
    masks: np.ndarray  # bit (label mod 64) is set if such a label occurs below
    leaf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    below: np.ndarray

    @staticmethod
    def grow(x: np.ndarray, labels: np.ndarray, ids: list[list[int]]) -> CoverTree:
        plain = x.astype(float)
        squares = (plain * plain).sum(1)
        norm = float(squares.max(initial=0.0))
        lifted = np.hstack([plain, np.sqrt(np.maximum(norm - squares, 0.0))[:, None]])
        slack = 1e-9 * (math.sqrt(norm) + 1)  # of distances, for rounding

        def away(rows: np.ndarray, centre: int) -> np.ndarray:
            gap = lifted[rows] - lifted[centre]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        bits = np.left_shift(np.uint64(1), (labels % 64).astype(np.uint64))
        centres, radii, masks, leaf, spans, below = [], [], [], [], [], []

        def node(centre: int, rows: np.ndarray, far: np.ndarray) -> int:
            centres.append(centre)
            radii.append(float(far.max()) + slack)
            masks.append(np.bitwise_or.reduce(bits[rows]))
            leaf.append(len(rows) <= LEAF_POINTS or far.max() <= slack)
            spans.append((0, 0))
            return len(centres) - 1

        every = np.arange(len(x))
        far = away(every, 0)
        todo = [(node(0, every, far), every, far)]
        while todo:
            at, rows, far = todo.pop()
            begin = len(below)
            if leaf[at]:
                below.extend(rows.tolist())
            else:
                reach = radii[at] / 2  # the next level: centres further apart than this, each covering what is nearer
                children, centre, near = [], centres[at], far <= reach
                while True:
                    children.append((centre, rows[near], far[near]))
                    rows = rows[~near]
                    if not len(rows):
                        break
                    centre = int(rows[0])
                    far = away(rows, centre)
                    near = far <= reach
                made = [(node(*child), child[1], child[2]) for child in children]
                below.extend(n for n, _, _ in made)
                todo.extend(made)
            spans[at] = (begin, len(below))
        most = float(np.abs(x).max(initial=0))
        exact = most * most * max(1, x.shape[1]) < EXACT
        start, end = np.array(spans).T
        return CoverTree(
            x, plain if exact else None, most, labels, ids, norm, np.array(centres), np.array(radii), np.array(masks, np.uint64), np.array(leaf), start, end,
            np.array(below),
        )

    def search(self, q: np.ndarray, windows: list[tuple[int | None, int | None]], label: int, same: bool, k: int) -> list[list[tuple[int, int]]]:
        """Per window of scores (low, high; None is open) the best k (score, id) of the label's points, or of all others."""
        most_q = float(np.abs(q).max(initial=0))
        exact = self.floats is not None and self.most * most_q * max(1, len(q)) < EXACT
        plain, square = q.astype(float), float((q.astype(float) ** 2).sum())
        total, known = square + self.norm, {}
        slack = 1e-9 * (total + 1)
        wanted = np.uint64(1) << np.uint64(label % 64)

        def products(rows: np.ndarray) -> np.ndarray:
            return (self.floats[rows] @ plain).astype(np.int64) if exact else self.x[rows] @ q

        def bounds(nodes: np.ndarray, ips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            far, r = np.sqrt(np.maximum(total - 2 * ips, 0.0)), self.radius[nodes]
            return (total - (far + r) ** 2) / 2 - slack, (total - np.maximum(far - r, 0.0) ** 2) / 2 + slack

        def opened(at: int):
            """What is below a node: exact scores of its points, and its inner nodes under their bounds."""
            if at not in known:
                below = self.below[self.start[at] : self.end[at]]
                rows = below if self.leaf[at] else self.centre[below]
                ips = products(rows)
                single = np.ones(len(rows), bool) if self.leaf[at] else self.end[below] - self.start[below] == 1
                # a child of one point is that point; larger ones are judged by their bounds
                single &= True if self.leaf[at] else self.leaf[below]
                fits = (self.labels[rows] == label) == same
                inner = below[~single]
                if same and len(inner):
                    keep = (self.masks[inner] & wanted) > 0
                    low, high = bounds(inner[keep], ips[~single][keep])
                    inner = inner[keep]
                else:
                    low, high = bounds(inner, ips[~single])
                known[at] = rows[single & fits], ips[single & fits], inner, low, high
            return known[at]

        out = []
        for lowest, highest in windows:
            lowest, highest = -math.inf if lowest is None else lowest, math.inf if highest is None else highest
            best: list[tuple[int, int]] = []  # (-score, id), sorted
            root_low, root_high = bounds(np.array([0]), products(self.centre[:1]))
            heap = [(-float(root_high[0]), 0)] if root_high[0] >= lowest and root_low[0] <= highest else []
            while heap:
                high, at = heapq.heappop(heap)
                least = -best[-1][0] if len(best) == k else lowest
                if -high < least:
                    break
                rows, ips, inner, low, up = opened(at)
                keep = np.flatnonzero((ips >= least) & (ips <= highest))
                if len(keep):
                    if len(keep) > k:  # only the best k points of a node can matter, with all that tie with the last
                        keep = keep[ips[keep] >= np.partition(ips[keep], -k)[-k]]
                    best = heapq.nsmallest(k, best + [(-int(ips[i]), v) for i in keep for v in self.ids[rows[i]]])
                    least = -best[-1][0] if len(best) == k else lowest
                for i in np.flatnonzero((up >= least) & (low <= highest)):
                    heapq.heappush(heap, (-float(up[i]), int(inner[i])))
            out.append([(-s, v) for s, v in best])
        return out


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """One row per vector and label with its smallest ``keep`` ids, and its name ``point``."""
    first = Window.partitionBy("label", "x").orderBy("id")
    kept = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    points = kept.groupBy("label", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return points.select(_name().alias("point"), "label", "x", "ids")


def _name() -> Column:
    return F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("x").cast("array<string>")), 256)


def _in_cells(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Points with the number of the nearest pivot of their length."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x in batch.column("x"):
                q = np.array(x.as_py(), float)
                gap = pivots[len(q)] - q if len(q) in pivots else np.zeros((1, 1))
                cells.append(int((gap * gap).sum(1).argmin()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    return points.mapInArrow(nearest, points.withColumn("cell", F.lit(0)).schema)


def _grown(points: DataFrame) -> DataFrame:
    """One row per block: its tree, and what its root says before the tree is read."""
    schema = "block long, size long, centre array<long>, radius double, norm double, tree binary"

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        tree = CoverTree.grow(_vectors(table["x"]), table["label"].to_numpy(), table["ids"].to_pylist())
        row = {
            "block": table["block"][0].as_py(), "size": tree.x.shape[1], "centre": tree.x[tree.centre[0]].tolist(), "radius": float(tree.radius[0]),
            "norm": tree.norm, "tree": pickle.dumps(vars(tree)),
        }
        types = [("block", pa.int64()), ("size", pa.int64()), ("centre", pa.list_(pa.int64())), ("radius", pa.float64()), ("norm", pa.float64()), ("tree", pa.binary())]
        return pa.Table.from_pylist([row], schema=pa.schema(types))

    return points.groupBy("block").applyInArrow(grow, schema)


def _asked(queries: DataFrame, trees: DataFrame, size_of: Column, blocks: int, same: bool, k: int) -> DataFrame:
    """Per query and window (low, high) the best k (score, id) of all blocks that ``queries`` names in ``blocks``.

    ``queries`` has point, label, x, windows and blocks; a block is left out where the bounds of its root lie outside all
    windows.
    """
    pairs = queries.withColumn("block", F.explode("blocks")).drop("blocks")
    roots = trees.select("block", "size", "centre", "radius", "norm")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    total = dot("x", "x") + F.col("norm")
    far = F.sqrt(F.greatest(total - 2 * dot("x", "centre"), F.lit(0.0)))
    slack = (total + 1) * 1e-9
    high = (total - F.pow(F.greatest(far - F.col("radius"), F.lit(0.0)), 2)) / 2 + slack
    low = (total - F.pow(far + F.col("radius"), 2)) / 2 - slack
    met = pairs.join(roots, "block").where(F.size("x") == F.col("size")).withColumns({"_high": high, "_low": low})
    inside = lambda w: F.coalesce(w["low"] <= F.col("_high"), F.lit(True)) & F.coalesce(w["high"] >= F.col("_low"), F.lit(True))
    met = met.where(F.exists("windows", inside)).select("block", "point", "label", "x", "windows")
    met = met.withColumn("part", F.pmod(F.xxhash64("point"), size_of).cast("int"))
    spread = trees.select("block", "tree").withColumn("part", F.explode(F.sequence(F.lit(0), (size_of - 1).cast("int"))))
    schema = "point string, window int, score long, id long"

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        points, numbers, scores, ids = [], [], [], []
        if len(mine) and len(theirs):
            tree = CoverTree(**pickle.loads(theirs["tree"][0].as_py()))
            for row, q in zip(mine.select(["point", "label", "windows"]).to_pylist(), _vectors(mine["x"]), strict=True):
                windows = [(w["low"], w["high"]) for w in row["windows"]]
                for number, found in enumerate(tree.search(q, windows, row["label"], same, k)):
                    points += [row["point"]] * len(found)
                    numbers += [number] * len(found)
                    scores += [s for s, _ in found]
                    ids += [v for _, v in found]
        return pa.table({"point": pa.array(points, pa.string()), "window": pa.array(numbers, pa.int32()), "score": pa.array(scores, pa.int64()), "id": pa.array(ids, pa.int64())})

    return met.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(search, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Per point and window the best k of all blocks, as a sorted array of (score, id)."""
    order = Window.partitionBy("point", "window").orderBy(F.desc("score"), "id")
    kept = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return kept.groupBy("point", "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "score", "id"))), lambda f: F.struct(f["score"].alias("score"), f["id"].alias("id"))).alias("found"))


def mine(
    rows: DataFrame, anchors: Column, *, id: str = "vec_id", label: str = "label", vector: str = "x", positives: int = 5, negatives: int = 5,
    low_percent: int = 80, high_percent: int = 100,
) -> DataFrame:
    """Hard negatives of the rows that satisfy ``anchors`` (an expression over ``id``), per anchor and positive.

    An anchor's positives are its best ``positives`` rows of the same label by integer inner product; a positive's negatives
    are the best ``negatives`` rows of other labels whose score is between the two percentages of the positive's. Returns
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Starts jobs.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    keep = max(positives, negatives) + 1  # one of an answer's rows may be the anchor itself
    read = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("x"))
    read = read.where("id is not null and label is not null and x is not null and not exists(x, v -> v is null)")
    points = _points(read, keep).checkpoint()

    # Pivots, one set per vector length: a bounded sample, at most one per page.
    sizes = {row.size: row.n for row in points.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).collect()}
    pivots = {}
    for size, n in sizes.items():
        sample = points.where(F.size("x") == size).orderBy("point").limit(min(PIVOTS, -(-n // PAGE_POINTS))).select("x").collect()
        pivots[size] = np.array([row.x for row in sample], float).reshape(len(sample), size)
    cells = _in_cells(points, pivots).checkpoint()
    counts = cells.groupBy(F.size("x").alias("size"), "cell").agg(F.count("*").alias("n")).orderBy("size", "cell").collect()
    pages, blocks = [], 0
    for row in counts:  # at most PIVOTS rows per length
        pages.append((row.size, row.cell, blocks, -(-row.n // PAGE_POINTS)))
        blocks += pages[-1][3]
    paged = spark.createDataFrame(pages, "size int, cell int, first long, pages long")
    placed = cells.withColumn("size", F.size("x")).join(F.broadcast(paged), ["size", "cell"])
    trees = _grown(placed.withColumn("block", F.col("first") + F.pmod(F.conv(F.substring("point", 1, 8), 16, 10).cast("long"), F.col("pages")))).checkpoint()

    asking = read.where(F.expr("true") if anchors is None else anchors).distinct().withColumn("point", _name()).select(F.col("id").alias("anchor_id"), "point").checkpoint()
    queries = placed.join(asking.select("point").distinct(), "point", "left_semi").select("point", "label", "x", "first", "pages")
    groups = F.lit(max(1, -(-asking.select("point").distinct().count() // GROUP_QUERIES)))
    window = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    nothing = F.lit(None)
    everywhere = F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1)).cast("long"))
    own = F.sequence(F.col("first"), F.col("first") + F.col("pages") - 1)

    # Positives: the anchor's own cell, then whatever can still beat what was found there.
    near = _asked(queries.select("point", "label", "x", F.array(window(nothing, nothing)).alias("windows"), own.alias("blocks")), trees, groups, blocks, True, keep).checkpoint()
    floor = _best(near, keep).select("point", F.when(F.size("found") == keep, F.element_at("found", -1)["score"]).alias("low"))
    further = queries.join(floor, "point", "left").select(
        "point", "label", "x", F.array(window(F.col("low"), nothing)).alias("windows"), F.array_except(everywhere, own).alias("blocks")
    )
    alike = _best(near.unionByName(_asked(further, trees, groups, blocks, True, keep)), keep).select("point", F.col("found").alias("positives")).checkpoint()

    # Negatives: one window per distinct score of a positive.
    scores = F.array_distinct(F.transform("positives", lambda p: p["score"]))
    percent = lambda s, p: F.ceil(s.cast("decimal(38,0)") * p / 100)
    spans = F.transform("scores", lambda s: window(percent(s, low_percent), F.floor(s.cast("decimal(38,0)") * high_percent / 100)))
    opened = alike.select("point", scores.alias("scores")).withColumn("windows", spans)
    unlike = queries.join(opened.select("point", "windows"), "point").select("point", "label", "x", "windows", everywhere.alias("blocks"))
    others = _best(_asked(unlike, trees, groups, blocks, False, keep), keep).groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct("window", "found"))).alias("negatives"))

    known = alike.select("point", "positives", scores.alias("scores")).join(others, "point")
    met = asking.join(known, "point")
    chosen = F.slice(F.filter("positives", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    each = met.select("anchor_id", "scores", "negatives", F.explode(chosen).alias("p"))
    number = (F.array_position("scores", F.col("p.score")) - 1).cast("int")
    partners = F.slice(F.filter(F.element_at("negatives", number), lambda f: f["id"] != F.col("anchor_id")), 1, negatives)
    return each.select("anchor_id", "p", F.posexplode(partners).alias("at", "f")).select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("f.score").alias("negative_score"),
    )
