"""Ordered work on keyed series without ever holding an unbounded series in one task.

A series is the rows of one ``key`` ordered by ``order``, which is unique within the key. Two plans exist:

* *keyed*: ``Window.partitionBy(key)``. Used when the order column is a DATE: a series then holds at most
  one row per calendar day, so its length is bounded whatever the total volume.
* *chunked*: for timestamps or numbers, where one key may hold a third of all rows, and one day of it most of
  them. Rows are range-partitioned by (key, order), which cuts a hot key and a hot day alike, and get their
  position from the counts of the partitions before; chunks of equal length are cut from the positions, and
  windows run per (key, chunk). Frames that look back get copies of the last rows of the chunk before
  ("halo"); running totals get the total of all chunks before ("carry").

Both plans give the same rows, which the tests check for random chunk lengths.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpoint

CHUNK_ROWS = 100_000
_SLOT = {T.DateType: 366, T.TimestampType: 86_400_000_000, T.TimestampNTZType: 86_400_000_000}

SEQ, CHUNK, HOME = "_seq", "_chunk", "_home"


def is_bounded(df: DataFrame, order: str = "ts") -> bool:
    """True when the order column is a DATE, so that a series is no longer than the calendar."""
    return isinstance(df.schema[order].dataType, T.DateType)


def ordinal(df: DataFrame, order: str) -> Column:
    """The order column as a whole number that grows with it."""
    t = df.schema[order].dataType
    if isinstance(t, T.DateType):
        return F.unix_date(order).cast("long")
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(t, T.TimestampType):
        return F.unix_micros(order)
    return F.floor(F.col(order)).cast("long")


def slot_width(df: DataFrame, order: str) -> int:
    """Length of a slot of the order axis: a year of days, a day of microseconds, else 100,000 units."""
    return _SLOT.get(type(df.schema[order].dataType), 100_000)


def number_rows(
    df: DataFrame, key: Sequence[str], order: str = "ts", out: str = SEQ, chunked: bool = False
) -> DataFrame:
    """Add the 0-based position of each row in its series.

    A calendar series takes a window, or (``chunked``) numbers its rows within years, of 366 rows at most, and
    adds the counts of the years before. Other orders are numbered by ``_ranged_positions``. A frame that
    already holds ``_seq`` (from ``long_series``) is left as it is. NULL keys make a series like any other.
    """
    key = list(key)
    if out == SEQ and SEQ in df.columns:
        return df
    if not is_bounded(df, order):
        return _ranged_positions(df, key, order, out)
    if not chunked:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(order)).cast("long") - 1)
    d = df.withColumn("_slot", F.floor(ordinal(df, order) / slot_width(df, order)).cast("long"))
    before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        d.groupBy(*key, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*key, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    w = Window.partitionBy(*key, "_slot").orderBy(order)
    d = d.withColumn("_in", F.row_number().over(w).cast("long") - 1)
    return null_safe_join(d, counts, [*key, "_slot"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_slot")


def null_safe_join(d: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that also matches NULL keys; the columns of ``d`` stay, those of ``small`` beside ``on`` are added."""
    s = small.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(on)})
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)]
    return d.join(s, cond, how).drop(*[f"_on_{i}" for i in range(len(on))])


def ranged(df: DataFrame, key: Sequence[str], order: str = "ts") -> DataFrame:
    """Rows sorted over (key, order) across range partitions, with ``_rp_id`` = partition * 2**33 + place in it.

    The cuts are drawn from a sample of the rows, so that partitions are even whatever key or time span is hot. Two
    evaluations would sample differently: the numbered rows are written to the checkpoint folder, and a lost task is
    recomputed from what was written.
    """
    d = df.repartitionByRange(*key, order).sortWithinPartitions(*key, order)
    return checkpoint(d.withColumn("_rp_id", F.monotonically_increasing_id()))


def _ranged_positions(df: DataFrame, key: Sequence[str], order: str, out: str) -> DataFrame:
    """Positions from one range shuffle: place in the partition, less where the series starts in it, plus its rows before.

    A key has one record per partition it reaches into, so the records are as many as keys and partitions together.
    """
    d = ranged(df, key, order).withColumn("_rp_part", F.shiftright("_rp_id", 33))
    before = Window.partitionBy(*key).orderBy("_rp_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        d.groupBy(*key, "_rp_part")
        .agg(F.min("_rp_id").alias("_rp_from"), F.count(F.lit(1)).alias("_rp_rows"))
        .select(*key, "_rp_part", (F.coalesce(F.sum("_rp_rows").over(before), F.lit(0)) - F.col("_rp_from")).alias("_rp_shift"))
    )
    return null_safe_join(d, runs, [*key, "_rp_part"]).withColumn(out, F.col("_rp_id") + F.col("_rp_shift")).drop("_rp_id", "_rp_part", "_rp_shift")


def long_series(df: DataFrame, key: Sequence[str], order: str = "ts") -> DataFrame:
    """Positions for a long series, assigned once and written to the checkpoint folder.

    The chunked plan of every operator numbers rows (which writes them) and reads them twice, for totals per chunk
    and for rows; from here on it reads the written positions and does not number again. The result keeps the helper column ``_seq``.
    """
    return checkpoint(number_rows(df, key, order, chunked=True))


@dataclass(frozen=True)
class Series:
    """A frame prepared for ordered windows, and the windows to use on it.

    ``shared`` registers a window aggregate once under a helper column, however many results use it;
    ``add`` evaluates the registered ones before the results that refer to them.
    """

    df: DataFrame
    part: tuple[str, ...]
    order: str
    chunked: bool
    keep_seq: bool = False
    pending: dict[str, Column] = field(default_factory=dict)

    def shared(self, name: str, value: Column) -> Column:
        name = f"_w_{name}"
        self.pending.setdefault(name, value)
        return F.col(name)

    def add(self, cols: Mapping[str, Column]) -> DataFrame:
        """The frame with ``cols`` added, without halo rows and helper columns."""
        helpers = dict(self.pending)
        d = self.df.withColumns(helpers) if helpers else self.df
        return self.done(d.withColumns(dict(cols)).drop(*helpers))

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(self.order)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n-1 before it."""
        return self.ordered().rowsBetween(-(n - 1), 0)

    def span(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered().rowsBetween(lo, hi)

    def done(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and helper columns."""
        if not self.chunked:
            return df
        return df.filter(HOME).drop(CHUNK, HOME, *([] if self.keep_seq else [SEQ]))


def series(
    df: DataFrame,
    key: Sequence[str],
    order: str = "ts",
    lookback: int = 0,
    lookahead: int = 0,
    chunk_rows: int | None = None,
) -> Series:
    """Prepare ``df`` for frames that reach ``lookback`` rows back and ``lookahead`` rows ahead."""
    key = tuple(key)
    if chunk_rows is None and is_bounded(df, order):
        return Series(df, key, order, False)
    b = max(chunk_rows or CHUNK_ROWS, lookback, lookahead, 1)
    d = number_rows(df, key, order, chunked=True).withColumn("_own", F.floor(F.col(SEQ) / b))
    pos = F.col(SEQ) - F.col("_own") * b
    places = F.array_compact(
        F.array(
            F.col("_own"),
            F.when(pos >= b - lookback, F.col("_own") + 1),
            F.when((pos < lookahead) & (F.col("_own") > 0), F.col("_own") - 1),
        )
    )
    d = d.withColumn(CHUNK, F.explode(places)).withColumn(HOME, F.col(CHUNK) == F.col("_own")).drop("_own")
    return Series(d, (*key, CHUNK), order, True, SEQ in df.columns)


# ---------------------------------------------------------------------------------------------------------
# Running totals

_AGG = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if kind == "product":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b)
    if kind == "last":
        return F.coalesce(b, a)
    return (F.greatest if kind == "max" else F.least)(a, b)


def running(
    df: DataFrame,
    key: Sequence[str],
    items: Mapping[str, tuple[str, Column | str]],
    order: str = "ts",
    reverse: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add running ``sum | product | max | min | last`` columns: ``{out: (kind, column)}``.

    NULLs are skipped; ``last`` is the last non-null value. ``reverse`` runs from the end of the series.
    """
    key = list(key)
    exprs = {o: (k, F.col(c) if isinstance(c, str) else c) for o, (k, c) in items.items()}

    def over(w: WindowSpec, kind: str, c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(w) if kind == "last" else _AGG[kind](c).over(w)

    if chunk_rows is None and is_bounded(df, order):
        by = F.col(order).desc() if reverse else F.col(order)
        w = Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: over(w, k, c) for o, (k, c) in exprs.items()})

    b = chunk_rows or CHUNK_ROWS
    d = number_rows(df, key, order, chunked=True).withColumn(CHUNK, F.floor(F.col(SEQ) / b))
    pos = F.col(SEQ)
    if reverse:
        pos = -pos
        d = d.withColumn(CHUNK, -F.col(CHUNK))
    d = d.withColumns({f"_x_{o}": c for o, (_, c) in exprs.items()})
    aggs = []
    for o, (k, _) in exprs.items():
        x = F.col(f"_x_{o}")
        aggs.append((F.max_by(x, F.when(x.isNotNull(), pos)) if k == "last" else _AGG[k](x)).alias(f"_t_{o}"))
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        d.groupBy(*key, CHUNK)
        .agg(*aggs)
        .select(*key, CHUNK, *[over(before, k, F.col(f"_t_{o}")).alias(f"_c_{o}") for o, (k, _) in exprs.items()])
    )
    w = Window.partitionBy(*key, CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(carry, [*key, CHUNK])
    d = d.withColumns({o: _combine(k, F.col(f"_c_{o}"), over(w, k, F.col(f"_x_{o}"))) for o, (k, _) in exprs.items()})
    drop = [CHUNK] + ([] if SEQ in df.columns else [SEQ]) + [f"_{p}_{o}" for o in exprs for p in ("x", "c")]
    return d.drop(*drop)


# ---------------------------------------------------------------------------------------------------------
# First-order recurrences y_t = a*y_{t-1} + b_t


def _blocks(decays: Sequence[float], length: int | None) -> list[tuple[int, list[float]]]:
    """Group decays so that one block length suits all: a**-B stays finite and a**B is negligible."""
    groups: list[tuple[int, list[float]]] = []
    for a in sorted(set(decays)):
        rate = -math.log(a)
        longest, shortest = int(300 / rate), math.ceil(41 / rate)
        if groups and shortest <= groups[-1][0]:
            groups[-1][1].append(a)
        else:
            groups.append((longest, [a]))
    if length is not None:
        groups = [(length, [a for _, g in groups for a in g])]
    return groups


def recurrence(
    df: DataFrame,
    key: Sequence[str],
    items: Mapping[str, tuple[float, Column]],
    order: str = "ts",
    block: int | None = None,
    seq: str | None = None,
) -> DataFrame:
    """Add ``{out: (a, b)}`` where out_t = a*out_{t-1} + b_t over the series; NULL b counts as 0.

    Inside a block of length B the recurrence is ``a**p * sum(b * a**-p)``, a running sum. Terms older than
    one whole block weigh less than a**B < 1e-17, so only the sum of the block before is carried over; no
    row depends on the length of the series, and (key, block) groups never exceed B rows.
    """
    key = list(key)
    bounded = is_bounded(df, order)
    d = df if seq else number_rows(df, key, order)
    pos = seq or SEQ
    for b_len, decays in _blocks([a for a, _ in items.values()], block):
        mine = {o: (a, b) for o, (a, b) in items.items() if a in decays}
        d = d.withColumn("_blk", F.floor(F.col(pos) / b_len))
        p = (F.col(pos) - F.col("_blk") * b_len).cast("double")
        lifted = {o: F.coalesce(b, F.lit(0.0)) * F.exp(p * F.lit(-math.log(a))) for o, (a, b) in mine.items()}
        inside = Window.partitionBy(*key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        if bounded:
            prior = Window.partitionBy(*key).orderBy("_blk").rangeBetween(-1, -1)
            d = d.withColumns({f"_c_{o}": F.sum(x).over(inside) for o, x in lifted.items()})
            d = d.withColumns({f"_p_{o}": F.coalesce(F.sum(x).over(prior), F.lit(0.0)) for o, x in lifted.items()})
        else:
            totals = (
                d.groupBy(*key, "_blk")
                .agg(*[F.sum(x).alias(f"_p_{o}") for o, x in lifted.items()])
                .withColumn("_blk", F.col("_blk") + 1)
            )
            d = d.withColumns({f"_c_{o}": F.sum(x).over(inside) for o, x in lifted.items()})
            d = d.join(totals, [*key, "_blk"], "left").fillna(0.0, [f"_p_{o}" for o in lifted])
        d = d.withColumns(
            {
                o: F.exp(p * F.lit(math.log(a))) * F.col(f"_c_{o}")
                + F.exp((p + b_len) * F.lit(math.log(a))) * F.col(f"_p_{o}")
                for o, (a, _) in mine.items()
            }
        ).drop(*[f"_{q}_{o}" for o in mine for q in ("c", "p")])
    return d.drop("_blk", *([] if seq else [SEQ]))
