"""Ordered folds whose state depends on earlier decisions: GPS jump clusters (W7), doubled readings.

A plain fold would hold a whole vehicle in one task. Here each is a rule for ``block_chain``: which states may stand at a
block's end, which blocks may change a state, and how a block is folded from a given state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_RADIUS_MILES, haversine_miles
from ..functions.measures import time_block
from .block_chain import PLAIN, UNCHANGED, Columns, Fold, fold_rows, settle, untouched
from .sequences import BLOCK_MINUTES

# Workers need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------- W7


def _miles(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2
    a = a + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_MILES * np.arcsin(np.sqrt(a))


class Track:
    """The rows of one block, in order, with the step from the row before; the first row's is known from the block before."""

    def __init__(self, y: np.ndarray, x: np.ndarray, t: np.ndarray, before: tuple[float, float, int], limit: float):
        py, px, pt = np.roll(y, 1), np.roll(x, 1), np.roll(t, 1)
        py[0], px[0], pt[0] = before
        has, had = ~(np.isnan(y) | np.isnan(x)), ~(np.isnan(py) | np.isnan(px))
        self.valid = has & had & (t > pt)
        self.step = np.full(len(y), np.inf)
        self.step[self.valid] = _miles(py[self.valid], px[self.valid], y[self.valid], x[self.valid])
        self.y, self.x, self.py, self.px = y, x, py, px
        self.jumps = np.flatnonzero(self.valid & (self.step > limit))

    def first_return(self, cy: float, cx: float, k: int) -> int:
        """The first row from ``k`` on that ends a cluster left at (cy, cx); the number of rows if none does."""
        width, n = 64, len(self.y)
        while k < n:
            to = min(k + width, n)
            back = ~self.valid[k:to] | (_miles(cy, cx, self.y[k:to], self.x[k:to]) <= self.step[k:to])
            if back.any():
                return k + int(np.argmax(back))
            k, width = to, width * 2
        return n

    def walk(self, cy: float, cx: float) -> tuple[list[tuple[int, int]], int]:
        """The clusters as (first row, end), from the entry state (NaN: none is open), and the state at the end."""
        n, found, free = len(self.y), [], 0
        if not np.isnan(cy):
            end = self.first_return(cy, cx, 0)
            found.append((0, end))
            if end == n:
                return found, UNCHANGED
            free = end + 1
        while (at := int(np.searchsorted(self.jumps, free))) < len(self.jumps):
            j = int(self.jumps[at])
            end = self.first_return(self.py[j], self.px[j], j + 1)
            found.append((j, end))
            if end == n:
                return found, j
            free = end + 1
        return found, PLAIN


class JumpFold(Fold):
    """State: the last position before an open cluster. The plain state is none."""

    def __init__(self, key: str, ts: str, lat: str, lon: str, limit: float):
        super().__init__(key, [ts], [ts, lat, lon], ["prev_lat", "prev_lon", "prev_ts"])
        self.ts, self.lat, self.lon, self.limit = ts, lat, lon, limit

    def _tracks(self, columns: Columns, starts: np.ndarray, ends: np.ndarray) -> Iterator[Track]:
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            before = tuple(columns[c][i] for c in self.known)
            yield Track(columns[self.lat][i:j], columns[self.lon][i:j], columns[self.ts][i:j], before, self.limit)

    def open_states(self, columns, starts, ends):
        out = []
        for number, track in enumerate(self._tracks(columns, starts, ends)):
            for j in track.jumps.tolist():
                if track.first_return(track.py[j], track.px[j], j + 1) == len(track.y):
                    out.append((number, j, track.py[j], track.px[j]))
        number, code, y, x = zip(*out, strict=True) if out else [()] * 4
        return np.array(number, int), np.array(code, int), np.array(y, float), np.array(x, float)

    def meets(self, a, b, blocks):
        n = len(blocks["unusual"])
        if np.isnan(a):
            return np.arange(n) == 0, np.arange(n) == 0
        # The least distance to the box of a block's positions; a return is within the block's longest step.
        high, low = blocks["lat_high"], blocks["lat_low"]
        up = np.maximum(0, np.maximum(low - a, a - high))
        side = np.maximum(0, np.maximum(blocks["lon_low"] - b, b - blocks["lon_high"]))
        side = np.minimum(side, np.maximum(0, 360 - np.maximum(abs(blocks["lon_low"] - b), abs(blocks["lon_high"] - b))))
        narrow = np.minimum(np.cos(np.radians(low)), np.cos(np.radians(high))).clip(0)
        part = np.maximum(np.sin(np.radians(up) / 2) ** 2, np.cos(np.radians(a)) * narrow * np.sin(np.radians(np.minimum(side, 180)) / 2) ** 2)
        least = 2 * EARTH_RADIUS_MILES * np.arcsin(np.sqrt(part.clip(0, 1)))
        gap = blocks["gap"].astype(bool)
        with np.errstate(invalid="ignore"):
            possible = gap | ~(least > blocks["step"] * (1 + 1e-9) + 1e-6)
            sure = gap | (_miles(a, b, blocks["far_lat"], blocks["far_lon"]) < blocks["step"] * (1 - 1e-9) - 1e-6)
        return possible, sure

    def leave(self, columns, starts, ends, block, a, b):
        tracks = list(self._tracks(columns, starts, ends))
        return np.array([tracks[i].walk(y, x)[1] for i, y, x in zip(block.tolist(), a.tolist(), b.tolist(), strict=True)], int)

    def rows(self, columns, starts, ends, a, b):
        flags = np.zeros(len(columns[self.lat]), bool)
        for track, start, y, x in zip(self._tracks(columns, starts, ends), starts.tolist(), a.tolist(), b.tolist(), strict=True):
            for first, end in track.walk(y, x)[0]:
                flags[start + first : start + end] = True
        return {"gps_outlier": flags}


def flag_gps_jumps(
    samples: DataFrame,
    *,
    key: str = "veh_id",
    ts: str = "timestamp",
    lat: str = "latitude",
    lon: str = "longitude",
    max_jump_miles: float = 5.0,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """Add ``gps_outlier`` to samples that are unique per (key, ts).

    A jump of more than ``max_jump_miles`` between neighbours opens a cluster; a point stays in it until it
    is at least as close to the last normal point as to its predecessor. A missing position, or time that
    does not advance, ends it. Starts a fixed number of jobs: clusters crossing blocks are settled before returning.
    """
    rows = samples.withColumn("block", time_block(F.col(ts), block_minutes))
    in_block = Window.partitionBy(key, "block").orderBy(ts)
    y, x = (F.when(~F.isnan(c), F.col(c)) for c in (lat, lon))
    narrow = rows.select(key, "block", ts, y.alias(lat), x.alias(lon))
    place = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(ts).alias("ts"))
    stepped = narrow.withColumn("before", F.lag(place).over(in_block))

    def step(then: Column, now: Column) -> Column:
        return F.when(now["ts"] > then["ts"], haversine_miles(then["lat"], then["lon"], now["lat"], now["lon"]))

    longest = F.struct(F.col("step"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    summed = (
        stepped.withColumn("step", F.when(F.col("before").isNotNull(), step(F.col("before"), place)))
        .groupBy(key, "block")
        .agg(
            F.max_by(place, ts).alias("last"), F.min_by(place, ts).alias("first"),
            F.max(F.when(F.col("step").isNotNull(), longest)).alias("longest"),
            F.bool_or(F.col("before").isNotNull() & F.col("step").isNull()).alias("gap"),
            *[f(c).alias(f"{name}_{side}") for name, c in (("lat", lat), ("lon", lon)) for side, f in (("low", F.min), ("high", F.max))],
        )
        .withColumn("prev", F.lag("last").over(Window.partitionBy(key).orderBy("block")))
        .withColumn("entry", step(F.col("prev"), F.col("first")))
    )
    entered = F.when(F.col("entry").isNotNull(), F.struct(F.col("entry").alias("step"), F.col("first.lat").alias("lat"), F.col("first.lon").alias("lon")))
    farthest = F.greatest("longest", entered)
    nothing = F.lit(None).cast("double")
    blocks = summed.select(
        key, "block", *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in ("lat", "lon", "ts")],
        F.coalesce(F.col("longest.step") > max_jump_miles, F.lit(False)).__or__(F.coalesce(F.col("entry") > max_jump_miles, F.lit(False))).alias("unusual"),
        nothing.alias("plain_a"), nothing.alias("plain_b"), (F.col("gap") | F.col("entry").isNull()).alias("gap"),
        F.coalesce(farthest["step"], F.lit(0.0)).alias("step"), farthest["lat"].alias("far_lat"), farthest["lon"].alias("far_lon"),
        "lat_low", "lat_high", "lon_low", "lon_high",
    )
    fold = JumpFold(key, ts, lat, lon, max_jump_miles)
    entries = settle(narrow, blocks, fold, every_block=False)
    flagged = fold_rows(rows, entries, fold, T.StructType([T.StructField("gps_outlier", T.BooleanType())]))
    plain = untouched(rows, entries, key).withColumn("gps_outlier", F.lit(False))
    return plain.unionByName(flagged).drop("block")


def null_gps_jumps(samples: DataFrame, *, lat: str = "latitude", lon: str = "longitude", **options) -> DataFrame:
    """W7 as the loader applies it: positions of flagged samples become null."""
    flagged = flag_gps_jumps(samples, lat=lat, lon=lon, **options)
    keep = ~F.col("gps_outlier")
    return flagged.withColumns({lat: F.when(keep, F.col(lat)), lon: F.when(keep, F.col(lon))})


# ---------------------------------------------------------------- W8

# Below this a kept mileage is too small for its halves to be judged by summaries.
_SMALL = 1e-6
# Values in one lockstep table.
_CELLS = 4_000_000


class DoublingFold(Fold):
    """State: the last kept (mileage, soc). The plain state is the raw reading of the row before.

    A state's code is 4 x row + 1 if the mileage was halved + 2 if the soc was.
    """

    def __init__(self, key: str, order: list[str], tolerance: float):
        super().__init__(key, order, ["mileage", "soc"], [])
        self.tolerance, self.lowest = tolerance, 1.0 - tolerance

    def _near(self, a, b):
        return np.abs(a - b) <= self.tolerance * np.maximum(np.abs(b), 1e-9)

    def _lockstep(self, columns: Columns, starts: np.ndarray, ends: np.ndarray, pm: np.ndarray, ps: np.ndarray, each=None) -> np.ndarray:
        """Fold all lanes side by side, one row of each per step; lanes of like length share a table. Codes at the end.

        ``each`` gets (rows, kept, mileage halved, soc halved, mileage, soc) of every step.
        """
        sizes, codes = ends - starts, np.full(len(starts), UNCHANGED)
        order = np.argsort(sizes, kind="stable")
        miles, socs = columns["mileage"], columns["soc"]
        with np.errstate(invalid="ignore"):
            while len(order):
                some = order[-max(1, _CELLS // max(1, int(sizes[order[-1]]))) :]
                order = order[: len(order) - len(some)]
                m0, s0, left, first = pm[some].copy(), ps[some].copy(), sizes[some], starts[some]
                for r in range(int(left.max(initial=0))):
                    cut = int(np.searchsorted(left, r, side="right"))  # shorter lanes have ended
                    rows = first[cut:] + r
                    m, s, pm_, ps_ = miles[rows], socs[rows], m0[cut:], s0[cut:]
                    half_m, half_s = self._near(m - pm_, pm_), self._near(s, 2.0 * ps_)
                    m, s = np.where(half_m, m / 2.0, m), np.where(half_s, s / 2.0, s)
                    kept = ~((m < 0) | (m < pm_ * self.lowest) | (s < 0) | (s > 1))
                    m0[cut:], s0[cut:] = np.where(kept, m, pm_), np.where(kept, s, ps_)
                    codes[some[cut:]] = np.where(kept, 4 * r + half_m + 2 * half_s, codes[some[cut:]])
                    if each is not None:
                        each(rows, kept, half_m, half_s, m, s)
        return codes

    def open_states(self, columns, starts, ends):
        m, s = columns["mileage"], columns["soc"]
        block = np.repeat(np.arange(len(starts)), ends - starts)
        row = np.arange(len(m)) - starts[block]
        with np.errstate(invalid="ignore"):
            sound = np.where((m >= 0) & ~((s < 0) | (s > 1)) | np.isnan(m), m, -np.inf)
            # The greatest sound mileage behind each row of its block: a running maximum from the end, block by block.
            behind = np.full(len(m), -np.inf)
            for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                behind[i : j - 1] = np.maximum.accumulate(sound[i + 1 : j][::-1])[::-1]
            out = []
            for variant in range(4):
                a, b = (m / 2 if variant & 1 else m), (s / 2 if variant & 2 else s)
                lasting = (behind < a * self.lowest) | (a < _SMALL)
                kept = ~((a < 0) | (b < 0) | (b > 1)) & ~((variant & 2 > 0) & np.isnan(s))
                plain = (row == (ends - starts)[block] - 1) & (variant == 0)
                at = np.flatnonzero(lasting & kept & ~plain)
                out.append((block[at], 4 * row[at] + variant, a[at], b[at]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def meets(self, a, b, blocks):
        with np.errstate(invalid="ignore"):
            sound = ~np.isnan(blocks["sound"].astype(float)) | blocks["odd_mileage"].astype(bool)
            enough = sound if np.isnan(a) else (blocks["sound"].astype(float) >= a * self.lowest) | blocks["odd_mileage"].astype(bool)
        sure = enough & (np.isnan(a) or a >= _SMALL)
        return sure | blocks["high_soc"].astype(bool) | (a < _SMALL), sure

    def leave(self, columns, starts, ends, block, a, b):
        codes = self._lockstep(columns, starts[block], ends[block], a, b)
        return np.where(codes == 4 * (ends - starts)[block] - 4, PLAIN, codes)

    def rows(self, columns, starts, ends, a, b):
        n = len(columns["mileage"])
        out = {"kept": np.zeros(n, bool), "mileage_fixed": np.zeros(n, bool), "soc_fixed": np.zeros(n, bool)}
        out |= {"mileage_new": columns["mileage"].copy(), "soc_new": columns["soc"].copy()}

        def each(rows, kept, half_m, half_s, m, s):
            out["kept"][rows], out["mileage_fixed"][rows], out["soc_fixed"][rows] = kept, half_m, half_s
            out["mileage_new"][rows[kept]], out["soc_new"][rows[kept]] = m[kept], s[kept]

        self._lockstep(columns, starts, ends, a, b, each)
        return out


def _unusual(m: Column, s: Column, pm: Column, ps: Column, tolerance: float) -> Column:
    """Whether a reading needs the fold, given the raw reading before it."""

    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1e-9))

    tests = [near(m - pm, pm), near(s, 2 * ps), m < 0, m < pm * (1 - tolerance), (s < 0) | (s > 1)]
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def repair_doubled(
    samples: DataFrame,
    *,
    key: str = "veh_id",
    ts: str = "timestamp",
    row: str = "row_no",
    tolerance: float = 0.05,
    block_minutes: int = BLOCK_MINUTES,
) -> DataFrame:
    """Halve mileage and SOC readings that doubled against the last kept row; mark rows to drop.

    Adds ``kept``, ``mileage_fixed`` and ``soc_fixed`` and replaces mileage and soc. Rows without key, time
    or mileage are not part of any series and are left out; ``row`` breaks ties of equal times. Starts jobs.
    """
    rows = samples.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col("mileage").isNotNull())
    rows = rows.withColumn("block", time_block(F.col(ts), block_minutes))
    order = [ts, row]
    in_block = Window.partitionBy(key, "block").orderBy(*order)
    here = F.struct(F.col("mileage").alias("m"), F.col("soc").alias("s"))
    odd = _unusual(
        F.col("mileage"), F.col("soc"), F.lag("mileage").over(in_block), F.lag("soc").over(in_block), tolerance
    )
    place = F.struct(*order)
    sound = (F.col("mileage") >= 0) & F.coalesce(F.col("soc").between(0, 1), F.lit(True))
    by_block = Window.partitionBy(key).orderBy("block")
    blocks = (
        rows.select(key, "block", *order, "mileage", "soc")
        .withColumn("odd", odd)
        .groupBy(key, "block")
        .agg(F.min_by(here, place).alias("first"), F.max_by(here, place).alias("last"), F.bool_or("odd").alias("odd"),
             F.max(F.when(sound, F.col("mileage"))).alias("sound"), F.bool_or(F.isnan("mileage")).alias("odd_mileage"), F.bool_or(F.coalesce(F.col("soc") > 1, F.lit(False))).alias("high_soc"))
        .withColumn("prev", F.lag("last").over(by_block))
    )
    entry_odd = _unusual(F.col("first.m"), F.col("first.s"), F.col("prev.m"), F.col("prev.s"), tolerance)
    blocks = blocks.select(
        key, "block", (F.col("odd") | entry_odd).alias("unusual"), F.col("prev.m").alias("plain_a"), F.col("prev.s").alias("plain_b"),
        F.col("sound").cast("double").alias("sound"), "odd_mileage", "high_soc",
    )
    fold = DoublingFold(key, order, tolerance)
    entries = settle(rows.select(key, "block", *order, "mileage", "soc"), blocks, fold, every_block=True)
    flags = [T.StructField(c, T.BooleanType()) for c in ("kept", "mileage_fixed", "soc_fixed")]
    values = [T.StructField(c, T.DoubleType()) for c in ("mileage_new", "soc_new")]
    folded = fold_rows(rows, entries, fold, T.StructType([*flags, *values]))
    folded = folded.withColumns({"mileage": F.col("mileage_new"), "soc": F.col("soc_new")}).drop("mileage_new", "soc_new")
    plain = untouched(rows, entries, key).withColumns({"kept": F.lit(True), "mileage_fixed": F.lit(False), "soc_fixed": F.lit(False)})
    return plain.unionByName(folded).drop("block")
