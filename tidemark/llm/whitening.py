"""Whitening of embeddings from exact covariances, added up by bits.

Entries become whole numbers. In a task, every dimension's numbers of a block of rows are shifted to zero and cut into
bit planes, 64 rows to a word. The cross-product of two dimensions is then a weighted sum of the bits that two planes
have in common: AND, population count, shift. Sums stay whole numbers of any size until the covariance is complete,
which is centred as whole numbers too; only the eigenvectors are floating point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column

#: Entries beyond this size count as this size, so that products of sums over any table fit 38 digits.
LARGEST = 2.0**40
#: Numbers (rows times dimensions) in a block of bit planes.
BLOCK = 1 << 19
#: Components of less variance than this share of the largest are taken as constant.
FLAT = 1e-12
SUMS_SCHEMA = "i int, j int, total decimal(38,0)"


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(vectors: pa.Array, dim: int, scale: int, shift: int) -> np.ndarray:
    """``floor(scale * c) + shift`` of vectors of ``dim`` entries, a row for each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    return np.floor(scale * np.clip(flat, -LARGEST, LARGEST)).astype("i8") + shift


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, products)`` of the columns of whole numbers, exact: arrays of Python numbers, products for ``i <= j``."""
    rows, dim = x.shape
    low = x.min(axis=0)
    y = np.zeros((-(-rows // 64) * 64, dim), "u8")
    y[:rows] = (x - low).view("u8")
    planes, of_dim, bits = [], [], []
    for bit in range(int(y.max()).bit_length()):
        plane = np.packbits(np.ascontiguousarray(((y >> np.uint64(bit)) & np.uint64(1)).astype("u1").T), axis=1).view("u8")
        some = np.flatnonzero(plane.any(axis=1))
        planes.append(plane[some])
        of_dim.append(some)
        bits.append(np.full(len(some), bit))
    sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
    if planes and sum(map(len, planes)):
        order = np.lexsort((np.concatenate(bits), np.concatenate(of_dim)))
        plane, of_dim, bits = (np.concatenate(a)[order] for a in (planes, of_dim, bits))
        narrow = 2 * int(bits.max()) + rows.bit_length() + 8 < 63
        weight = np.int64(1) << bits if narrow else np.array([1 << int(b) for b in bits], object)
        first = np.searchsorted(of_dim, np.arange(dim))
        shown = np.flatnonzero(np.append(first[1:], len(of_dim)) > first)  # dimensions with a plane
        np.add.at(sums, of_dim, np.bitwise_count(plane).sum(axis=1).astype("i8") * weight)
        for a in range(len(plane)):
            i, begin = of_dim[a], first[of_dim[a]]
            common = np.bitwise_count(plane[a] & plane[begin:]).sum(axis=1).astype("i8")
            later = shown[shown >= i]
            products[i, later] += np.add.reduceat(common * weight[begin:], first[later] - begin) * weight[a]
    low, shifted = low.astype(object), sums
    upper = np.triu(np.ones((dim, dim), bool))
    products = np.where(upper, products + np.outer(low, shifted) + np.outer(shifted, low) + rows * np.outer(low, low), 0)
    return shifted + rows * low, products


def scatter(vectors: DataFrame, dim: int, scale: int, shift: int) -> DataFrame:
    """``i, j, total`` over the one column of vectors: cross-products of dimensions ``i <= j``; ``j = -1`` for sums, ``i = j = -1`` for the number of rows.

    A task adds up its blocks and sends ``dim * (dim + 3) / 2 + 1`` numbers, whatever its number of rows.
    """
    most = max(64, BLOCK // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            for at in range(0, b.num_rows, most):
                x = whole(b.column(0).slice(at, most), dim, scale, shift)
                s, p = cross_products(x)
                n, sums, products = n + len(x), sums + s, products + p
        if not n:
            return
        i, j = np.triu_indices(dim)
        left, right = np.concatenate(([-1], np.arange(dim), i)), np.concatenate(([-1], np.full(dim, -1), j))
        total = pa.array([str(v) for v in [n, *sums, *products[i, j]]]).cast(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), total], names=["i", "j", "total"])

    return vectors.mapInArrow(run, SUMS_SCHEMA).groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


@dataclass(frozen=True)
class Whitening:
    """Exact sums of the fit list and its components; ``axes`` has a unit row per component, ``variance`` falls."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    variance: np.ndarray
    axes: np.ndarray
    scale: int
    shift: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``; 64-bit numbers where they and their squares' sums fit, else Python's."""
        most = max((max(abs(int(x.max())), abs(int(x.min()))) + 1) * self.n + max(map(abs, self.sums)), 1) if x.size else 1
        d = self.n * x.astype(object if most >= 2**62 else "i8") - np.array(self.sums, object if most >= 2**62 else "i8")
        far = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
        return d if far * far * self.dim < 2**62 else d.astype(object)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """Projections of deviations over the square root of their variance; NaN for a component that does not vary."""
        flat = self.variance <= FLAT * max(float(self.variance[0]), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (d / self.n).astype("f8") @ (self.axes / np.sqrt(np.where(flat, np.nan, self.variance))[:, None]).T
        return np.where(flat, np.nan, z)


def fit_whitening(vectors: DataFrame, dim: int, components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Components of all vectors; None without any. The driver gets ``dim * (dim + 3) / 2 + 1`` numbers."""
    got = {(r["i"], r["j"]): int(r["total"]) for r in scatter(vectors, dim, scale, shift).collect()}
    if not got:
        return None
    n, sums = got[(-1, -1)], [got[(i, -1)] for i in range(dim)]
    v = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * got[(i, j)] - sums[i] * sums[j]) / (n * n)
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[: min(components, dim)]
    return Whitening(dim, n, sums, float(np.trace(v)), np.maximum(e[order], 0.0), axes[:, order].T.copy(), scale, shift)


def commonest_length(vectors: DataFrame) -> int | None:
    """Entries of most vectors, of several the fewest; None without vectors."""
    sizes = vectors.groupBy(F.size("vector").alias("dim")).count()
    top = sizes.orderBy(F.desc("count"), "dim").first()
    return None if top is None else top["dim"]


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity; over components that vary."""
    k = len(w.variance)
    i, j = np.triu_indices(k)
    names = [f"s{a}" for a in range(k)] + [f"p{a}_{b}" for a, b in zip(i, j)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(i))
        for b in batches:
            if b.num_rows:
                z = w.whitened(w.deviations(whole(b.column(0), w.dim, w.scale, w.shift)))
                total += np.concatenate((z.sum(axis=0), (z.T @ z)[i, j]))
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

    sums = vectors.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    s, p = np.array(sums[:k]) / w.n, np.array(sums[k:]) / w.n
    off = np.abs(p - s[i] * s[j] - (i == j))
    return float(np.nanmax(off)) if np.isfinite(off).any() else 0.0


OUT = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each vector on each component of all.

    An entry c counts as ``floor(scale * c) + shift``; entries beyond 2**40 either way count as 2**40. Null and empty
    vectors and those with null or non-finite entries take no part, nor do those of another length than most (of equally
    common lengths the shorter counts). Null ids stay, repeated ids and rows count each, other columns are ignored.
    ``deviation`` is the exact ``sum((n * x - S)**2)``. A component without variance (all vectors equal, or fewer
    vectors than components) has a null ``whitened`` and is left out of ``identity_error``. No vectors, no rows.
    """
    schema = T.StructType([T.StructField("vec_id", df.schema[vec_id].dataType), *[T.StructField(n, t) for n, t in OUT]])
    found = df.select(column(vec_id).alias("vec_id"), column(vector).alias("vector")).filter(usable(F.col("vector")))
    dim = commonest_length(found)
    if dim is None:
        return df.sparkSession.createDataFrame([], schema)
    kept = found.filter(F.size("vector") == dim)
    w = fit_whitening(kept.select("vector"), dim, components, scale, shift)
    error, k = identity_error(kept.select("vector"), w), len(w.variance)
    explained = w.variance / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                part = b.slice(at, 1 << 12)
                rows = part.num_rows
                d = w.deviations(whole(part.column(1), dim, scale, shift))
                z = w.whitened(d)
                squares = (d * d).sum(axis=1)
                deviation = (pa.array(squares) if squares.dtype != object else pa.array([str(v) for v in squares])).cast(pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(rows), k))
                cols = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, w.n)), deviation.take(each),
                    pa.array(z.reshape(-1), mask=np.isnan(z.reshape(-1))), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return kept.mapInArrow(run, schema)
