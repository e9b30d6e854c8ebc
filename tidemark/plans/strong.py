"""Pairs of series with a correlation of at least a threshold, without a record for any other pair.

Series are bounded by the calendar and travel as arrays, in blocks that are written once; a pair of blocks is read from there
by one task, and only pairs over the threshold leave it, or of these the strongest of each series. A task first finds the
pairs that may count from matrix products in single precision, with a bound on their rounding, and works these out in full.
Series with a value on every date are sorted by their angle to a pivot (the mean of all series) before they are cut into blocks.
Angles between centred series obey the triangle inequality: two series whose angles to the pivot differ by more than
arccos(threshold) are no strong pair, so pairs of blocks are not read where series differ in how they follow the pivot.
Series with gaps have no such angle; their blocks meet all. The products are quadratic where nothing is pruned; what is
written is linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.pairs import WIDE, Block, all_days, meeting, write_blocks
from tidemark.plans.series import number_rows, ordinal
from tidemark.session import checkpoint

#: Series of the left and of the right block that are multiplied at a time, so that products stay in a core's cache, and pairs
#: that are worked out in full at a time. No fewer on the right than on the left.
STRIP, TILE, EXACT = 256, 1024, 2048
#: Share of a tile from which on it is worked out as a whole.
DENSE = 1 / 16
#: Values in a block of many series over few dates, which then holds up to so many series, and no less than the third number.
CELLS, WIDEST, NARROWEST = 3_000_000, 4 * WIDE, 256


class Side:
    """A block by series and dates: values less their series' mean, where there are any, in full and in single precision."""

    def __init__(self, s: Block, days: np.ndarray):
        with np.errstate(all="ignore"):
            count = np.bincount(s.of)
            self.mean, self.raw = np.bincount(s.of, s.xs) / count, np.bincount(s.of, s.xs * s.xs)
            xs = s.xs - self.mean[s.of]
            scale = np.sqrt(np.bincount(s.of, xs * xs) / count)
        use = (scale > 0) & np.isfinite(scale) & np.isfinite(self.raw)  # others make no pair
        self.m, self.most = s.m, int(count[use].max(initial=0))
        place = np.zeros(days[-1] - days[0] + 1, "i8")
        place[days - days[0]] = np.arange(len(days))
        at = s.of * len(days) + place[s.days - days[0]]
        if not use.all():
            at, xs = at[use[s.of]], xs[use[s.of]]
        self.x, self.k = np.zeros((len(count), len(days))), np.zeros((len(count), len(days)), bool)
        self.x.ravel()[at], self.k.ravel()[at] = xs, True
        scale[~use], self.mean[~use] = 1.0, 0.0
        self.rest = self.raw / (scale * scale)
        small = self.x / scale[:, None]
        self.small = np.stack((self.k, small, small * small), dtype="f4", casting="unsafe")  # there is one, value, square


def _exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray, min_dates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlation, whether there is one and common dates of pairs, each from its own dates alone."""
    c, ok, n = np.zeros(len(i)), np.zeros(len(i), bool), np.zeros(len(i), "i8")
    for at in range(0, len(i), EXACT):
        p = slice(at, at + EXACT)
        both = a.k[i[p]] & b.k[j[p]]
        n[p] = k = both.sum(1)
        sides, least = [], []
        for s, of in ((a, i[p]), (b, j[p])):
            x = s.x[of] * both
            x -= (x.sum(1) / k)[:, None] * both
            v, r = k * np.einsum("pt,pt->p", x, x), 1e-14 * k * s.raw[of]  # squares of all dates: no less than those of the common
            near = ~(v > r)
            whole = (s.x[of[near]] + s.mean[of[near], None]) * both[near]
            r[near] = 1e-14 * k[near] * np.einsum("pt,pt->p", whole, whole)
            sides.append((x, v))
            least.append(r)
        (x, vx), (y, vy) = sides
        ok[p] = (vx > least[0]) & (vy > least[1]) & (k >= max(min_dates, 2))  # rounding is no movement
        c[p] = k * np.einsum("pt,pt->p", x, y) / np.sqrt(np.where(ok[p], vx * vy, 1.0))
    return c, ok, n


def _whole(a: Side, b: Side, rows: slice, cols: slice, min_dates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of all pairs of a tile, by products of matrices; and where these lose digits, as common dates lie far from the means."""
    x, k, y, l = a.x[rows], a.k[rows].astype(float), b.x[cols].T, b.k[cols].T.astype(float)
    rx, ry = np.square((x + a.mean[rows, None]) * k), np.square((y + b.mean[cols]) * l)
    n, sx, sy, qx, qy = k @ l, x @ l, k @ y, (x * x) @ l, k @ (y * y)
    vx, vy = n * qx - sx * sx, n * qy - sy * sy
    ok = (vx > 1e-14 * n * (rx @ l)) & (vy > 1e-14 * n * (k @ ry)) & (n >= max(min_dates, 2))
    c = (n * (x @ y) - sx * sy) / np.sqrt(np.where(ok, vx * vy, 1.0))
    return c, ok, n.astype("i8"), ~((vx > 1e-6 * n * qx) & (vy > 1e-6 * n * qy))


class Screen:
    """Tiles of one block against the other in single precision: which pairs may count, and bounds on their correlation."""

    def __init__(self, a: Side, b: Side, same: bool, threshold: float, min_dates: int):
        self.a, self.b, self.same, self.min_dates = a, b, same, max(min_dates, 2)
        self.right = np.ascontiguousarray(b.small.transpose(0, 2, 1))  # dates by series
        self.out = np.empty((7, STRIP, TILE), "f4")
        most = max(a.most, b.most)
        # a sum of T products is off by at most T + 1 roundings of its size, which is the number of dates at most; the
        # variances and covariances by that of three such products, and by their own three roundings
        self.off = np.float32(4 * (a.x.shape[1] + 8) * 2.0**-24 * most * most)
        self.least = np.float32(threshold * threshold * (1 - 1e-5))

    def tiles(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Where a tile begins, its pairs that may count; for all its pairs the dates, sizes of covariance and variances."""
        for at in range(0, len(self.a.m), STRIP):
            for lo in range(at if self.same else 0, len(self.b.m), TILE):  # in a block of its own, each pair once
                may, sums = self.tile(self.a.small[:, at : at + STRIP], self.right[:, :, lo : lo + TILE])
                if self.same and at == lo:
                    may = np.triu(may, 1)
                i, j = np.divmod(np.flatnonzero(may), may.shape[1])
                yield at, lo, i, j, may, sums

    def tile(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        *out, t = self.out[:, : left.shape[1], : right.shape[2]]
        k, x, q, l, y, r = *left, *right
        n, sx, sy, sxx, syy, sxy = (np.matmul(u, v, out=o) for u, v, o in zip((k, x, k, q, k, x), (l, l, y, l, r, y), out, strict=True))
        sxx *= n
        sxx -= np.multiply(sx, sx, out=t)
        syy *= n
        syy -= np.multiply(sy, sy, out=t)
        sxy *= n
        sxy -= np.multiply(sx, sy, out=t)
        size = np.abs(sxy, out=sxy)
        floor = np.subtract(sxx, self.off, out=sx)
        np.maximum(floor, 0, out=floor)
        floor *= np.subtract(syy, self.off, out=sy)
        floor *= self.least
        most = np.add(size, self.off, out=t)
        most *= most
        may = most >= floor
        may &= n >= self.min_dates
        return may, [n, size, sxx, syy]

    def bounds(self, i, j, n, size, vx, vy) -> tuple[np.ndarray, np.ndarray]:
        """Size of the correlation at least (0 where there may be none) and at most."""
        off = np.float64(self.off)
        n, size, vx, vy = (v.astype("f8") for v in (n, size, vx, vy))
        low = np.maximum(size - off, 0) / np.sqrt((vx + off) * (vy + off))
        with np.errstate(divide="ignore"):
            high = (size + off) / np.sqrt(np.maximum(vx - off, 0) * np.maximum(vy - off, 0))
        sure = (vx - off > 1e-13 * n * self.a.rest[i]) & (vy - off > 1e-13 * n * self.b.rest[j]) & (low * low >= 1.0001 * self.least)
        return np.where(sure, low * (1 - 1e-9), 0.0), high * (1 + 1e-9)


def _place(of: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``of``, then by ``by``, and in this order the place within ``of``."""
    order = np.lexsort((*by[::-1], of))
    s = of[order]
    return order, np.arange(len(s)) - np.searchsorted(s, s)


def _kth(of: np.ndarray, low: np.ndarray, top: int, series: int) -> np.ndarray:
    """For each series the ``top``-th of the lower bounds, 0 where there are fewer."""
    order, place = _place(of, -low)
    out, last = np.zeros(series), order[place == top - 1]
    out[of[last]] = low[last]
    return out


def _pairs(a: Side, b: Side, same: bool, threshold: float, min_dates: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``i, j, corr, n`` of the pairs over the threshold, tile by tile."""
    for at, lo, i, j, may, _ in Screen(a, b, same, threshold, min_dates).tiles():
        if len(i) <= DENSE * may.size:
            c, ok, n = _exact(a, b, i + at, j + lo, min_dates)
        else:
            c, ok, n, rough = (v[i, j] for v in _whole(a, b, slice(at, at + STRIP), slice(lo, lo + TILE), min_dates))
            c[rough], ok[rough], n[rough] = _exact(a, b, i[rough] + at, j[rough] + lo, min_dates)
        ok &= np.abs(c) >= threshold
        yield i[ok] + at, j[ok] + lo, c[ok], n[ok]


def _candidates(a: Side, b: Side, same: bool, threshold: float, min_dates: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the ``top`` strongest of one of their series."""
    screen, found = Screen(a, b, same, threshold, min_dates), []
    for at, lo, i, j, may, sums in screen.tiles():
        low, high = screen.bounds(i + at, j + lo, *(v[i, j] for v in sums))
        if len(i) > DENSE * may.size and min(may.shape) > top:  # cut in the tile what the tile alone rules out
            lows = np.zeros(may.shape)
            lows[i, j] = low
            keep = (high >= np.partition(lows, -top, 1)[:, -top][i]) | (high >= np.partition(lows, -top, 0)[-top][j])
            i, j, low, high = i[keep], j[keep], low[keep], high[keep]
        found.append((i + at, j + lo, low, high))
    i, j, low, high = map(np.concatenate, zip(*found, strict=True))
    if same:
        kth = _kth(np.concatenate((i, j)), np.tile(low, 2), top, len(a.m))
        keep = (high >= kth[i]) | (high >= kth[j])
    else:
        keep = (high >= _kth(i, low, top, len(a.m))[i]) | (high >= _kth(j, low, top, len(b.m))[j])
    return i[keep], j[keep]


def _strong(a: Block, b: Block, same: bool, threshold: float, min_dates: int) -> Iterator[pa.RecordBatch]:
    """``a, b, corr, n`` of two blocks' pairs over the threshold."""
    days = all_days(a, b)
    left = Side(a, days)
    for i, j, c, n in _pairs(left, left if same else Side(b, days), same, threshold, min_dates):
        one, two = a.m.take(pa.array(i)), b.m.take(pa.array(j))
        swap = pc.greater(one, two)
        yield pa.RecordBatch.from_arrays([pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.array(c), pa.array(n)], names=["a", "b", "corr", "n"])


def _strongest(a: Block, b: Block, same: bool, threshold: float, min_dates: int, top: int) -> Iterator[pa.RecordBatch]:
    """``asset, other, corr, n``: of two blocks' pairs over the threshold the ``top`` strongest of each series."""
    days = all_days(a, b)
    left = Side(a, days)
    right = left if same else Side(b, days)
    i, j = _candidates(left, right, same, threshold, min_dates, top)
    c, ok, n = _exact(left, right, i, j, min_dates)
    ok &= np.abs(c) >= threshold
    i, j, c, n = i[ok], j[ok], c[ok], n[ok]
    names = a.m if same else pa.concat_arrays([a.m, b.m])
    j = j if same else j + len(a.m)
    of, other, c, n = np.concatenate((i, j)), np.concatenate((j, i)), np.tile(c, 2), np.tile(n, 2)
    order, place = _place(of, -np.abs(c), pc.rank(names).to_numpy()[other])
    keep = order[place < top]
    yield pa.RecordBatch.from_arrays([names.take(pa.array(of[keep])), names.take(pa.array(other[keep])), pa.array(c[keep]), pa.array(n[keep])], names=["asset", "other", "corr", "n"])


def width(series: int, dates: int, cores: int) -> int:
    """Series in a block: as many as a task can hold, for fewer reads of a block, but pairs of blocks for all cores."""
    most = max(WIDE, min(WIDEST, CELLS // max(1, dates)))
    return max(NARROWEST, min(most, math.ceil(series / math.sqrt(8 * cores))))


def packed(df: DataFrame, member: str, value: str, order: str) -> tuple[DataFrame, int]:
    """``m, days, xs, angle``: a record per series; the angle to the pivot is NULL for series with gaps. And the number of dates."""
    x = F.col(value).cast("double")
    d = df.filter(F.col(member).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(F.col(member).cast("string").alias("m"), ordinal(df, order).cast("int").alias("day"), x.alias("x"))
    d = d.groupBy("m", "day").agg(F.max("x").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("day", "x")))  # the calendar at most
    s = checkpoint(d.groupBy("m").agg(rows.alias("r")).select("m", F.col("r.day").alias("days"), F.col("r.x").alias("xs")))

    def values(of: DataFrame) -> DataFrame:
        return of.select("m", F.explode(F.arrays_zip("days", "xs")).alias("e")).select("m", F.col("e.days").alias("day"), F.col("e.xs").alias("x"))

    pivot = checkpoint(values(s).groupBy("day").agg(F.avg("x").alias("_pivot")))
    dates = pivot.count()
    full = F.size("days") == dates
    c = F.try_divide(F.covar_pop("x", "_pivot"), F.stddev_pop("x") * F.stddev_pop("_pivot"))
    c = values(s.filter(full)).join(pivot, "day").groupBy("m").agg(c.alias("c"))
    angle = F.when(F.col("c").isNotNull() & ~F.isnan("c"), F.acos(F.greatest(F.least("c", F.lit(1.0)), F.lit(-1.0))))
    gaps = s.filter(~full).withColumn("angle", F.lit(None).cast("double"))
    return gaps.unionByName(s.filter(full).join(c, "m").select("m", "days", "xs", angle.alias("angle"))), dates


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """``_p, _q, rows, others``: the pairs of blocks that may hold a strong pair, from ``_blk, rows, lo, hi`` (NULL angles: with gaps)."""
    arc = math.acos(min(1.0, threshold)) + 1e-6  # a hair wide, for rounding
    left = blocks.withColumnRenamed("_blk", "_p")
    right = blocks.withColumnsRenamed({"_blk": "_q", "rows": "others", "lo": "_lo", "hi": "_hi"})
    near = F.greatest(F.col("lo") - F.col("_hi"), F.col("_lo") - F.col("hi")) <= arc
    opposite = F.greatest(F.col("lo") + F.col("_lo") - math.pi, math.pi - F.col("hi") - F.col("_hi")) <= arc
    return meeting(left, right, (F.col("_p") <= F.col("_q")) & F.coalesce(near | opposite, F.lit(True))).drop("lo", "hi", "_lo", "_hi")


def strong_pairs(
    df: DataFrame, threshold: float, member: str = "asset", value: str = "ret", order: str = "ts", min_dates: int = 20, block: int | None = None, top: int | None = None
) -> DataFrame:
    """``a, b, corr, n`` of the pairs a < b with a size of corr >= threshold over ``min_dates`` common dates or more.

    With ``top`` rows are ``asset, other, corr, n`` and hold the ``top`` strongest of each series in any two blocks, from both
    sides of a pair: all that can be among its strongest, and few others.
    """
    s, dates = packed(df, member, value, order)
    has = F.col("angle").isNotNull()
    counts = s.agg(F.count("angle").alias("full"), F.count_if(~has).alias("gaps")).first()
    block = block or width(counts["full"] + counts["gaps"], dates, s.sparkSession.sparkContext.defaultParallelism)
    gaps = math.ceil(counts["gaps"] / block)
    parts = s.filter(~has).withColumn("_blk", 2 * F.pmod(F.xxhash64("m"), F.lit(max(1, gaps))) + 1)
    if counts["full"]:
        d = s.filter(has).withColumn("_by", F.struct("angle", F.xxhash64("m"))).withColumn("_all", F.lit(0))  # those of one angle are parted by name
        d = number_rows(d, ["_all"], "_by", "_at").withColumn("_blk", 2 * F.floor(F.col("_at") / block)).drop("_all", "_by", "_at")
        parts = parts.unionByName(d)
    blocks = write_blocks(parts, ["_blk"], max(1, gaps + math.ceil(counts["full"] / block)), F.min("angle").alias("lo"), F.max("angle").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                same = t["_p"][i].as_py() == t["_q"][i].as_py()
                a = Block(t["rows"][i])
                b = a if same else Block(t["others"][i])
                yield from _strong(a, b, same, threshold, min_dates) if top is None else _strongest(a, b, same, threshold, min_dates, top)

    return block_pairs(blocks, threshold).mapInArrow(run, f"{'a string, b string' if top is None else 'asset string, other string'}, corr double, n long")
