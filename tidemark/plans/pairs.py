"""Sums over all pairs of members, without emitting a record per pair and date.

Series ordered by DATE are bounded by the calendar. They are packed into blocks, a record and a partition each, which are
written once; a pair of blocks is read from there by one task, whose matrix products are the sums of its pairs over all
dates. Nothing is shuffled per pair, and no row is copied per block, so what lies on disk grows with the rows alone.

Other orders are unbounded: members are hashed into blocks and dates into buckets. Each row is copied once per pair of
blocks its own block takes part in; one (block pair, date bucket) group is a small dense panel whose products are matrix
products, and only those sums leave the task. Group size is bounded by block size times bucket length, so
neither a long calendar nor a large universe piles up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import is_bounded, ordinal, slot_width
from tidemark.session import checkpoint

BLOCK = 256
#: Series in a block that is read by tasks, and those of its left side that are multiplied at a time.
WIDE, STRIP = 2048, 64
#: Pairs that leave a task at a time, and those after which the same pairs the other way round follow.
PIECE, NEAR = 1 << 16, 1 << 10
SUMS = dict.fromkeys(("a", "b"), "string") | dict.fromkeys(("n", "sx", "sy", "sxx", "syy", "sxy"), "double")


def write_blocks(s: DataFrame, by: Sequence[str], blocks: int, *more: Column) -> DataFrame:
    """``by, rows`` and aggregates ``more``: series ``m, days, xs`` as a record per block, written about one to a partition."""
    rows = F.collect_list(F.struct("m", "days", "xs"))  # WIDE series of the calendar's length at most
    return checkpoint(s.repartitionByRange(blocks, *by).groupBy(*by).agg(rows.alias("rows"), *more))


def meeting(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
    """Pairs of written blocks that meet ``near``: tasks read them where they were written, none is shuffled."""
    return left.join(right.hint("shuffle_replicate_nl"), near)


class Block:
    """The series of a block, from an entry of a column ``rows``."""

    def __init__(self, rows: pa.ListScalar):
        self.m, days, xs = rows.values.flatten()
        self.of = np.repeat(np.arange(len(days)), pc.list_value_length(days).to_numpy(zero_copy_only=False))
        self.days, self.xs = days.flatten().to_numpy(zero_copy_only=False), xs.flatten().to_numpy(zero_copy_only=False)

    def panel(self, days: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values, in the order of ``xs``, as dates by series; 0 where there is none."""
        x = np.zeros((len(days), len(self.m)))
        x[np.searchsorted(days, self.days), self.of] = values
        return x


def all_days(a: Block, b: Block) -> np.ndarray:
    d = np.concatenate((a.days, b.days))
    return np.flatnonzero(np.bincount(d - d.min())) + d.min()


def _products(a: Block, b: Block) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Strips of ``a`` against the whole of ``b``: where a strip begins, and its ``n, sx, sy, sxx, syy, sxy``."""
    days = all_days(a, b)
    (xa, ka), (xb, kb) = [(s.panel(days, s.xs), s.panel(days, np.ones(len(s.xs)))) for s in (a, b)]
    qa, qb = xa * xa, xb * xb
    for at in range(0, len(a.m), STRIP):
        x, k, q = (v[:, at : at + STRIP].T for v in (xa, ka, qa))
        yield at, [k @ kb, x @ kb, k @ xb, q @ kb, k @ qb, x @ xb]


def _block_sums(a: Block, b: Block, mirror: bool) -> Iterator[list[pa.Array]]:
    """``a, b, n, sx, sy, sxx, syy, sxy`` of all pairs of two blocks, and of the pairs (b, a)."""
    for at, sums in _products(a, b):
        i, j = np.nonzero(sums[0] > 0)
        ma, mb = a.m.take(pa.array(i + at)), b.m.take(pa.array(j))
        n, sx, sy, sxx, syy, sxy = (pa.array(v[i, j]) for v in sums)
        yield [ma, mb, n, sx, sy, sxx, syy, sxy]
        if mirror:
            yield [mb, ma, n, sy, sx, syy, sxx, sxy]


def _moves(v: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``v > least`` as Spark compares, to which NaN is the largest number."""
    return (v > least) | (np.isnan(v) & ~np.isnan(least))


def _block_correlations(a: Block, b: Block, mirror: bool) -> Iterator[list[pa.Array]]:
    """``a, b, corr, n`` of all pairs of two blocks, and of the pairs (b, a), rows of like correlation side by side.

    The result has a row per pair whatever is done, so its files are what fills the disk. In order of correlation, and with
    (b, a) close to (a, b), equal numbers follow one another and compress to less than half.
    """
    corr, n = np.empty((len(a.m), len(b.m))), np.empty((len(a.m), len(b.m)), "i4")
    ok = np.empty(corr.shape, bool)
    with np.errstate(all="ignore"):
        for at, (k, sx, sy, sxx, syy, sxy) in _products(a, b):
            vx, vy = k * sxx - sx * sx, k * syy - sy * sy
            rows = slice(at, at + len(k))
            ok[rows] = _moves(vx, 1e-14 * k * sxx) & _moves(vy, 1e-14 * k * syy)
            corr[rows], n[rows] = (k * sxy - sx * sy) / np.sqrt(vx * vy), k
    corr[~ok] = np.nan
    corr, n, ok = corr.ravel(), n.ravel(), ok.ravel()
    by = np.argsort(corr)
    by = by[n[by] > 0]
    names = pa.concat_arrays([a.m, b.m])
    for at in range(0, len(by), PIECE):
        p = by[at : at + PIECE]
        one, two = p // len(b.m), p % len(b.m) + len(a.m)
        if mirror:
            turn = 2 * (np.arange(len(p)) // NEAR)
            rows = np.argsort(np.concatenate((turn, turn + 1)).astype("i2"), kind="stable")
            one, two, p = np.concatenate((one, two))[rows], np.concatenate((two, one))[rows], np.tile(p, 2)[rows]
        yield [names.take(pa.array(one)), names.take(pa.array(two)), pa.array(corr[p], mask=~ok[p]), pa.array(n[p].astype("i8"))]


def _whole_series(d: DataFrame, g: list[str], members: int | None, sums: Callable[[Block, Block, bool], Iterator[list[pa.Array]]], returns: Mapping[str, str]) -> DataFrame:
    """``sums`` of all pairs of series that the calendar bounds, with columns ``returns``, from ``g, m, day, x``."""
    rows = F.array_sort(F.collect_list(F.struct("day", "x")))
    s = d.groupBy(*g, "m").agg(rows.alias("r")).select(*g, "m", F.col("r.day").alias("days"), F.col("r.x").alias("xs"))
    s = checkpoint(s)  # read twice below: to draw the cuts between blocks, and to write them
    if members is None:
        members = s.agg(F.approx_count_distinct("m").alias("n")).first()["n"]
    blocks = max(1, math.ceil(members / WIDE))
    left = write_blocks(s.withColumn("_p", F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int")), [*g, "_p"], blocks)
    right = left.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_p").alias("_q"), F.col("rows").alias("others"))
    near = F.col("_p") <= F.col("_q")
    for c in g:
        near &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    names = [*g, *returns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                same = t["_p"][i].as_py() == t["_q"][i].as_py()
                a = Block(t["rows"][i])
                for found in sums(a, a if same else Block(t["others"][i]), not same):
                    head = [pa.repeat(t[c][i], len(found[0])) for c in g]
                    yield pa.RecordBatch.from_arrays([*head, *found], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in g] + [f"{c} {t}" for c, t in returns.items()])
    return meeting(left, right, near).mapInArrow(run, schema)


def _panel_sums(pdf: pd.DataFrame, extra: list[str]) -> pd.DataFrame:
    days, t = np.unique(pdf["_day"].to_numpy(), return_inverse=True)
    sides = []
    for side in ("_p", "_q"):
        names = np.sort(pdf.loc[pdf["_blk"] == pdf[side], "m"].unique())
        rows = (pdf["_blk"] == pdf[side]).to_numpy()
        x, k = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        col = np.searchsorted(names, pdf.loc[rows, "m"].to_numpy())
        x[t[rows], col] = pdf.loc[rows, "x"].to_numpy()
        k[t[rows], col] = 1.0
        sides.append((names, x, k))
    (na, xa, ka), (nb, xb, kb) = sides
    n = ka.T @ kb
    out = {
        "a": np.repeat(na, len(nb)),
        "b": np.tile(nb, len(na)),
        "n": n.ravel(),
        "sx": (xa.T @ kb).ravel(),
        "sy": (ka.T @ xb).ravel(),
        "sxx": ((xa * xa).T @ kb).ravel(),
        "syy": (ka.T @ (xb * xb)).ravel(),
        "sxy": (xa.T @ xb).ravel(),
    }
    res = pd.DataFrame(out)
    res = res[res["n"] > 0]
    for c in extra:
        res.insert(0, c, pdf[c].iloc[0])
    return res


def _known(df: DataFrame, member: str, value: str, order: str, g: list[str]) -> DataFrame:
    """``g, m, day, x`` of the rows with a value."""
    d = df.filter(F.col(value).isNotNull())
    return d.select(*g, F.col(member).cast("string").alias("m"), ordinal(df, order).alias("day"), F.col(value).cast("double").alias("x"))


def pair_sums(
    df: DataFrame,
    member: str = "asset",
    value: str = "ret",
    order: str = "ts",
    group: Sequence[str] = (),
    members: int | None = None,
) -> DataFrame:
    """``group, a, b, n, sx, sy, sxx, syy, sxy`` over the dates where both a and b have a value.

    Holds all ordered pairs (a, b), a = b included. ``members`` is the universe size; when not given it is
    estimated by one pass, as it decides how many blocks are cut.
    """
    g = list(group)
    d = _known(df, member, value, order, g)
    if is_bounded(df, order):
        return _whole_series(d.withColumn("day", F.col("day").cast("int")), g, members, _block_sums, SUMS)
    if members is None:
        members = d.agg(F.approx_count_distinct("m").alias("n")).first()["n"]
    blocks = max(1, math.ceil(members / BLOCK))
    d = d.withColumnRenamed("day", "_day").withColumn("_blk", F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumn("_p", F.least("_blk", "_other")).withColumn("_q", F.greatest("_blk", "_other"))
    d = d.withColumn("_bucket", F.floor(F.col("_day") / slot_width(df, order)))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in reversed(g)] + ["a string", "b string"] + [f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    part = d.drop("_other").groupBy(*g, "_p", "_q", "_bucket").applyInPandas(lambda p: _panel_sums(p, g), schema)
    sums = part.groupBy(*g, "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    if blocks == 1:
        return sums
    # panels of two different blocks hold (a, b) only once: add the mirrored pair
    mirrored = sums.filter(F.pmod(F.xxhash64("a"), F.lit(blocks)) != F.pmod(F.xxhash64("b"), F.lit(blocks))).select(
        *g, F.col("b").alias("a"), F.col("a").alias("b"), "n", F.col("sy").alias("sx"), F.col("sx").alias("sy"),
        F.col("syy").alias("sxx"), F.col("sxx").alias("syy"), "sxy",
    )
    return sums.unionByName(mirrored)


def pair_correlations(
    df: DataFrame, member: str = "asset", value: str = "ret", order: str = "ts", group: Sequence[str] = (), members: int | None = None
) -> DataFrame:
    """``group, a, b, corr, n`` of all ordered pairs (a, b), a = b included, over the dates where both have a value.

    ``corr`` is NULL where a or b does not move on these dates.
    """
    g = list(group)
    if is_bounded(df, order):
        d = _known(df, member, value, order, g).withColumn("day", F.col("day").cast("int"))
        return _whole_series(d, g, members, _block_correlations, {"a": "string", "b": "string", "corr": "double", "n": "long"})
    n = F.col("n")
    c = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    ok = (vx > 1e-14 * n * F.col("sxx")) & (vy > 1e-14 * n * F.col("syy"))
    p = pair_sums(df, member, value, order, g, members)
    return p.select(*g, "a", "b", F.when(ok, c / F.sqrt(vx * vy)).alias("corr"), n.cast("long").alias("n"))
