"""Gaussian hidden Markov models over many series, or over long series cut into chunks.

Expectation runs where the rows are and returns sums; only K x d numbers reach the driver. A task works on many
series at once, time-major. A series bounded by the calendar is one group. A longer one is cut into chunks: the effect of
a chunk on the state is a K x K matrix, the matrices of all chunks are multiplied along a tree, level by level, and every
chunk is then processed with the exact state information from before and after it. The result equals that of the uncut
series, and no task sees more than one chunk's rows or ``FAN`` matrices of a series.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prep import winsor_limits
from tidemark.operators.regime import regime_labels, smooth_mode
from tidemark.plans import timemajor as tm
from tidemark.plans.folds import spread
from tidemark.plans.groups import group_starts, map_groups
from tidemark.plans.series import CHUNK, CHUNK_ROWS, SEQ, is_bounded, number_rows
from tidemark.session import checkpoint

KEY = ("series",)


@dataclass(frozen=True)
class Prep:
    """Limits and scale fixed at fitting time, per kept column."""

    cols: list[str]
    limits: dict[str, tuple[float, float]]
    mean: list[float]
    scale: list[float]


@dataclass(frozen=True)
class HmmParams:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    prep: Prep | None = None
    labels: list[str] = field(default_factory=list)
    log_likelihood: float = float("nan")
    iterations: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.start)


# ---------------------------------------------------------------------------------------------------------
# Features


def prepare_regime_features(df: DataFrame, cols: Sequence[str], prep: Prep | None = None, approx: bool = False) -> tuple[DataFrame, Prep]:
    """Winsorise, fill, drop constant columns and scale; adds ``x``. Limits and scale are those of fitting time."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown features: {missing}")
    limits = prep.limits if prep else winsor_limits(df, list(cols), approx=approx)

    def clean(c):
        lo, hi = limits[c]
        x = F.col(c).cast("double")
        x = F.when(F.isnan(x), None).when(x == float("inf"), hi).when(x == float("-inf"), lo).otherwise(x)
        return F.coalesce(F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo))), F.lit(0.0))

    if prep is None:
        m = df.agg(*[a for c in cols for a in (F.avg(clean(c)).alias(f"m_{c}"), F.var_pop(clean(c)).alias(f"v_{c}"))]).first()
        kept = [c for c in cols if m[f"v_{c}"] > 1e-8]
        prep = Prep(kept, limits, [m[f"m_{c}"] for c in kept], [m[f"v_{c}"] ** 0.5 for c in kept])
    x = F.array(*[(clean(c) - m) / s for c, m, s in zip(prep.cols, prep.mean, prep.scale)])
    return df.withColumn("x", x), prep


def log_density(x: np.ndarray, p: HmmParams) -> np.ndarray:
    """Log densities of the rows of one series in the states of a model."""
    return tm.densities(tm.Stack.of([x]), tm.Models.same(p, 1))[:, 0]


def order_states(p: HmmParams) -> HmmParams:
    """States by the variance of the first feature, so that state 0 is the calmest."""
    m = tm.ordered(tm.Models.same(p, 1))
    return replace(p, start=m.start[0], trans=m.trans[0], means=m.means[0], covs=m.covs[0])


def kmeans_init(df: DataFrame, k: int = 3, seed: int = 42) -> HmmParams:
    """Start from clusters of ``x``: their centres and covariances, sticky transitions, uniform start."""
    d = df.select("x").withColumn("v", array_to_vector("x"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="c").fit(d)
    dim = len(model.clusterCenters()[0])
    x = [F.col("x")[i] for i in range(dim)]
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    rows = model.transform(d).groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()  # k rows
    covs = np.tile(np.eye(dim), (k, 1, 1))
    for r in rows:
        if r["n"] > 1:
            for i, j in pairs:
                covs[r["c"], i, j] = covs[r["c"], j, i] = r[f"c{i}_{j}"] + (0.01 if i == j else 0.0)
    trans = np.ones((k, k)) + np.eye(k)
    return HmmParams(np.full(k, 1 / k), trans / trans.sum(1, keepdims=True), np.array(model.clusterCenters()), covs)


# ---------------------------------------------------------------------------------------------------------
# Distribution

#: Matrices that a task chains one after the other; more of them make another level of the tree.
FAN = 256


def _vectors(t: pa.Table, starts: np.ndarray, col: str = "x") -> list[np.ndarray]:
    """The rows of each group as an array."""
    flat = t[col].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(t.num_rows, -1)
    return [x[a:b] for a, b in zip(starts[:-1], starts[1:])]


def _lists(a: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A list of doubles per row of an array; null where ``mask``."""
    out = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a, dtype=float).ravel()), a.shape[1]).cast(pa.list_(pa.float64()))
    return out if mask is None else pc.if_else(pa.array(mask), pa.scalar(None, out.type), out)


def _kinds(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _heads(t: pa.Table, starts: np.ndarray, cols: Sequence[str], **more: pa.Array) -> pa.Table:
    """One row per group: its key and what was found for it."""
    return pa.table({**{c: t[c].take(pa.array(starts[:-1])) for c in cols}, **more})


def _product(k: int, best: bool):
    """All matrices of a group, multiplied in order."""
    reduce = (lambda a: a.max(1)) if best else (lambda a: tm.lse(a, 1))

    def run(t: pa.Table, starts: np.ndarray) -> np.ndarray:
        out = []
        for g in _vectors(t, starts, "m"):
            m = g[0].reshape(k, k)
            for row in g[1:]:
                m = reduce(m[:, :, None] + row.reshape(1, k, k))
            out.append(m.ravel())
        return np.array(out)

    return run


def _chain(ms: np.ndarray, best: bool, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[list, list]:
    """State information before and after each of some consecutive chunks (C, K, K), from that around all of them."""
    reduce = (lambda a, axis: a.max(axis)) if best else tm.lse
    b, a, at = [], [], before
    for m in ms:
        b.append(at)
        at = m[0] if at is None else reduce(at[:, None] + m, 0)
    at = np.zeros(ms.shape[1]) if after is None else after
    for m in ms[::-1]:
        a.append(at)
        at = reduce(m + at[None], 1)
    return b, a[::-1]


def state_ends(ms: DataFrame, key: Sequence[str], k: int, best: bool = False, fan: int | None = None) -> DataFrame:
    """``key, chunk, before, after`` from ``key, chunk, m``: what the other chunks of a series say of the state around each.

    Up the tree, blocks of ``fan`` consecutive matrices become their product; down the tree, a block hands its own
    ends to the matrices in it. ``before`` is null for the first chunk of a series.
    """
    key, fan = list(key), fan or FAN
    head, block = _kinds(ms, [*key, CHUNK]), F.floor(F.col(CHUNK) / fan).cast("long")
    span = (ms.agg(F.max(CHUNK).alias("n")).first()["n"] or 0) + 1
    multiply, levels = _product(k, best), [ms]
    while span > fan:
        up = map_groups(levels[-1].withColumn("_block", block), [*key, "_block"], [CHUNK], lambda t, s: _heads(t, s, [*key, "_block"], m=_lists(multiply(t, s))).rename_columns([*key, CHUNK, "m"]), f"{head}, m array<double>")
        levels.append(checkpoint(up))
        span = -(-span // fan)

    def ends(t: pa.Table, starts: np.ndarray) -> pa.Table:
        b, a = [], []
        known = "_after" in t.column_names
        for g, at in zip(_vectors(t, starts, "m"), starts):
            around = [None if v is None else np.array(v) for v in (t["_before"][at].as_py(), t["_after"][at].as_py())] if known else [None, None]
            gb, ga = _chain(g.reshape(-1, k, k), best, *around)
            b, a = b + gb, a + ga
        first = np.array([v is None for v in b])
        return t.select([*key, CHUNK]).append_column("before", _lists(np.array([np.zeros(k) if v is None else v for v in b]), first)).append_column("after", _lists(np.array(a)))

    schema = f"{head}, before array<double>, after array<double>"
    out = map_groups(levels[-1], key, [CHUNK], ends, schema)
    for lower in reversed(levels[:-1]):
        around = out.select(*key, F.col(CHUNK).alias("_block"), F.col("before").alias("_before"), F.col("after").alias("_after"))
        out = map_groups(lower.withColumn("_block", block).join(around, [*key, "_block"]), [*key, "_block"], [CHUNK], ends, schema)
    return out


def place(df: DataFrame, key: Sequence[str], order: str, chunk_rows: int | None = None) -> DataFrame:
    """Rows where their series or chunk is worked on, written once: further passes shuffle none of them.

    Series ordered by DATE are whole; others get positions and chunk numbers.
    """
    if chunk_rows is None and is_bounded(df, order):
        return checkpoint(spread(df, key))
    d = number_rows(df, key, order, chunked=True)
    d = d.withColumn(CHUNK, F.floor(F.col(SEQ) / (chunk_rows or CHUNK_ROWS)).cast("long"))
    return checkpoint(spread(d, [*key, CHUNK]))


def over_series(df: DataFrame, key: Sequence[str], p: HmmParams | None, fn, schema: str, order: str, best: bool = False, k: int | None = None) -> DataFrame:
    """``fn(table, starts, rows of each group, models, ends)`` over placed series or, exactly, over chunks of them.

    All have the model ``p``; or, without it, each its own of ``k`` states, which the column ``_model`` holds.
    """
    key, k = list(key), p.k if p is not None else k

    def models(t: pa.Table, starts: np.ndarray, xs: list[np.ndarray]) -> tm.Models:
        if p is not None:
            return tm.Models.same(p, len(xs))
        flat = t["_model"].take(pa.array(starts[:-1])).combine_chunks().flatten().to_numpy()
        return tm.Models.from_flat(flat.reshape(len(xs), -1), k, xs[0].shape[1])

    def alone(t: pa.Table, starts: np.ndarray) -> pa.Table:
        xs = _vectors(t, starts)
        return fn(t, starts, xs, models(t, starts, xs), tm.Ends.none(len(xs), k))

    if CHUNK not in df.columns:
        return map_groups(df, key, [order], alone, schema, placed=True)
    group = [*key, CHUNK]

    def effect(t: pa.Table, starts: np.ndarray) -> pa.Table:
        xs, first = _vectors(t, starts), t[CHUNK].to_numpy()[starts[:-1]] == 0
        m, out = models(t, starts, xs), np.empty((len(xs), k * k))
        for at, s in tm.stacks(xs):
            out[at] = tm.effects(s, m.pick(at), first[at], best).reshape(len(at), -1)
        return _heads(t, starts, group, m=_lists(out))

    own = ["_model"] if p is None else []
    ms = checkpoint(map_groups(df.select(*group, SEQ, "x", *own), group, [SEQ], effect, _kinds(df, group) + ", m array<double>", placed=True))
    ends = state_ends(ms, key, k, best)

    def both(t: pa.Table, starts: np.ndarray) -> pa.Table:
        at = pa.array(starts[:-1])
        before, after = (t[c].take(at).combine_chunks() for c in ("before", "after"))
        first = before.is_null().to_numpy(zero_copy_only=False)
        logs = np.zeros((len(first), k))
        logs[~first] = before.flatten().to_numpy().reshape(-1, k)
        xs = _vectors(t, starts)
        return fn(t, starts, xs, models(t, starts, xs), tm.Ends(logs, after.flatten().to_numpy().reshape(-1, k), first))

    return map_groups(df.join(ends, group), group, [SEQ], both, schema, placed=True)


def _each(xs: list[np.ndarray], m: tm.Models, ends: tm.Ends, fn) -> Iterator[tuple[np.ndarray, tm.Stack, np.ndarray]]:
    for at, s in tm.stacks(xs):
        yield at, s, fn(s, m.pick(at), ends.pick(at))


def expected_sums(xs: list[np.ndarray], m: tm.Models, ends: tm.Ends) -> np.ndarray:
    """What the maximisation needs of each series, a flat row for each; see ``sums_from``."""
    rows: np.ndarray | None = None
    for at, _, e in _each(xs, m, ends, tm.expected):
        flat = np.concatenate([e[n].reshape(len(at), -1) for n in tm.SUMS], axis=1)
        rows = np.empty((len(xs), flat.shape[1])) if rows is None else rows
        rows[at] = flat
    return rows


def packed(d: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Placed series of bounded length as stacks, ``n, x`` in binary: an iteration reads arrays and sorts no rows."""

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        found = [(s.n.astype("<i8").tobytes(), s.planes.tobytes()) for _, s in tm.stacks(_vectors(t, starts))]
        return pa.table({"n": pa.array([n for n, _ in found], pa.binary()), "x": pa.array([x for _, x in found], pa.binary())})

    return checkpoint(map_groups(d, key, [order], run, "n binary, x binary", placed=True))


def packed_sums(d: DataFrame, p: HmmParams, n_sums: int, few: bool = True) -> np.ndarray:
    """Sums of the expectation over stacks. A task returns one row; unless tasks are ``few``, these are summed before they are sent."""
    dim = p.means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_sums)
        for b in batches:
            for n, x in zip(b.column("n"), b.column("x")):
                s = tm.Stack.of_bytes(np.frombuffer(n.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), "f8"), dim)
                e = tm.expected(s, tm.Models.same(p, len(s.n)), tm.Ends.none(len(s.n), p.k))
                total += np.concatenate([e[c].reshape(len(s.n), -1).sum(0) for c in tm.SUMS])
        yield pa.RecordBatch.from_arrays([_lists(total[None])], names=["sums"])

    sums = d.mapInArrow(run, "sums array<double>")
    if few:
        return np.sum([r["sums"] for r in sums.collect()], axis=0)
    each = sums.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in each.orderBy("i").collect()])


def sums_from(rows: np.ndarray, k: int, d: int) -> dict[str, np.ndarray]:
    shapes = {"ll": (), "n": (), "g0": (k,), "g": (k,), "gx": (k, d), "gxx": (k, d, d), "xi": (k, k)}
    cut = np.cumsum([0, *[int(np.prod(s)) for s in shapes.values()]])
    return {n: rows[:, a:b].reshape(len(rows), *s) for (n, s), a, b in zip(shapes.items(), cut, cut[1:])}


def _features(df: DataFrame, p: HmmParams) -> DataFrame:
    return df if "x" in df.columns or p.prep is None else prepare_regime_features(df, list(p.prep.limits), p.prep)[0]


def _iterate(p: HmmParams, sums, max_iter: int, tol: float) -> HmmParams:
    """Expectation (``sums`` of a model, a flat row) and maximisation, until the likelihood settles."""
    last = -np.inf
    for it in range(1, max_iter + 1):
        e = sums_from(np.array([sums(p)], dtype=float), p.k, p.means.shape[1])
        m, ll = tm.maximised(e, tm.Models.same(p, 1)), float(e["ll"][0])
        p = replace(p, start=m.start[0], trans=m.trans[0], means=m.means[0], covs=m.covs[0], log_likelihood=ll, iterations=it, converged=ll - last < tol)
        if p.converged:
            break
        last = ll
    return p


def _fit_in_task(d: DataFrame, key: Sequence[str], order: str, p: HmmParams, max_iter: int, tol: float) -> HmmParams:
    """All iterations over few rows in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        stacks = [s for _, s in tm.stacks(_vectors(t, group_starts(t, key)))]

        def sums(q: HmmParams) -> np.ndarray:
            each = [tm.expected(s, tm.Models.same(q, len(s.n)), tm.Ends.none(len(s.n), q.k)) for s in stacks]
            return np.sum([np.concatenate([e[c].reshape(len(e["n"]), -1).sum(0) for c in tm.SUMS]) for e in each], axis=0)

        q = _iterate(p, sums, max_iter, tol)
        yield pa.RecordBatch.from_arrays([_lists(tm.Models.same(q, 1).flat()), pa.array([q.log_likelihood]), pa.array([q.iterations], pa.int32()), pa.array([q.converged])], names=["model", "ll", "it", "done"])

    r = d.repartition(1).sortWithinPartitions(*key, order).mapInArrow(run, "model array<double>, ll double, it int, done boolean").first()
    m = tm.Models.from_flat(np.array([r["model"]]), p.k, p.means.shape[1])
    return replace(p, start=m.start[0], trans=m.trans[0], means=m.means[0], covs=m.covs[0], log_likelihood=r["ll"], iterations=r["it"], converged=r["done"])


def fit_hmm(
    df: DataFrame, cols: Sequence[str], key: Sequence[str] = KEY, k: int = 3, max_iter: int = 2000, tol: float = 1e-2, seed: int = 42, order: str = "ts",
    label_order: str = "variance", approx: bool = False, chunk_rows: int | None = None, small_rows: int = 100_000,
) -> HmmParams:
    """One model pooled over all series. Each iteration is one job over the prepared features, which are
    written to the checkpoint folder once; a few hundred numbers come back. At most ``small_rows`` rows are iterated
    over in one task instead, with the same sums. ``converged`` says whether the likelihood settled within ``max_iter``."""
    d, prep = prepare_regime_features(df, cols, approx=approx)
    d = place(d.select(*key, order, "x", *([SEQ] if SEQ in d.columns else [])), key, order, chunk_rows)
    p = replace(kmeans_init(d, k, seed), prep=prep, labels=regime_labels(k))
    dim = len(prep.cols)
    names = [f"s{i}" for i in range(2 + 2 * k + k * dim * (1 + dim) + k * k)]
    whole = CHUNK not in d.columns
    if whole and d.count() <= small_rows:
        p = _fit_in_task(d, key, order, p, max_iter, tol)
    elif whole:
        stacks = packed(d, key, order)
        few = stacks.rdd.getNumPartitions() <= 1_000
        p = _iterate(p, lambda q: packed_sums(stacks, q, len(names), few), max_iter, tol)
    else:

        def step(t, starts, xs, m, ends):
            return pa.table({n: [v] for n, v in zip(names, expected_sums(xs, m, ends).sum(0))})

        schema, total = ", ".join(f"{n} double" for n in names), [F.sum(n).alias(n) for n in names]
        p = _iterate(p, lambda q: over_series(d, key, q, step, schema, order).agg(*total).first(), max_iter, tol)
    return order_states(p) if label_order == "variance" else p


def _placed(df: DataFrame, p: HmmParams, key: Sequence[str], order: str, chunk_rows: int | None) -> DataFrame:
    d = _features(df, p)
    return place(d.select(*key, order, "x", *([SEQ] if SEQ in d.columns else [])), key, order, chunk_rows)


def predict_regimes(df: DataFrame, p: HmmParams, smoothing: int = 5, key: Sequence[str] = KEY, order: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """``key, ts, state, label``: the most likely path, smoothed by the mode of the rows around."""
    d = _placed(df, p, key, order, chunk_rows)
    keep = [*key, order, *([SEQ] if SEQ in df.columns else [])]

    def run(t, starts, xs, m, ends):
        path = tm.paths_many(xs, m, ends)
        return t.select(keep).append_column("state", pa.array(np.concatenate(path), pa.int32()))

    out = over_series(d, key, p, run, _kinds(d, keep) + ", state int", order, True)
    if smoothing > 0:
        out = smooth_mode(out, smoothing, key, "state", order, chunk_rows=chunk_rows)
    names = p.labels or regime_labels(p.k)
    return out.withColumn("label", F.get(F.array(*[F.lit(x) for x in names]), F.col("state")))


def predict_proba(df: DataFrame, p: HmmParams, key: Sequence[str] = KEY, order: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """``key, ts, p``: probability of each state given the whole series."""
    d = _placed(df, p, key, order, chunk_rows)
    keep = [*key, order, *([SEQ] if SEQ in df.columns else [])]

    def run(t, starts, xs, m, ends):
        out: list[np.ndarray] = [np.empty(0)] * len(xs)
        for at, s, g in _each(xs, m, ends, tm.probabilities):
            for j, i in enumerate(at):
                out[i] = g[: s.n[j], j]
        return t.select(keep).append_column("p", _lists(np.concatenate(out)))

    return over_series(d, key, p, run, _kinds(d, keep) + ", p array<double>", order)


def information_criteria(df: DataFrame, p: HmmParams, key: Sequence[str] = KEY, order: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """Per series: log likelihood, AIC and BIC with (K^2 - 1) + 2K parameters."""
    d = _placed(df, p, key, order, chunk_rows)

    def run(t, starts, xs, m, ends):
        ll = np.zeros(len(xs))
        for at, _, v in _each(xs, m, ends, tm.likelihoods):
            ll[at] = np.where(ends.first[at], v, 0.0)
        return _heads(t, starts, key, ll=pa.array(ll), n=pa.array(np.diff(starts).astype(float)))

    s = over_series(d, key, p, run, _kinds(d, key) + ", ll double, n double", order)
    m = p.k * p.k - 1 + 2 * p.k
    s = s.groupBy(*key).agg(F.sum("ll").alias("log_likelihood"), F.sum("n").alias("n"))
    return s.withColumns({"aic": -2 * F.col("log_likelihood") + 2 * m, "bic": -2 * F.col("log_likelihood") + F.log("n") * m})


def transition_matrix_model(spark: SparkSession, p: HmmParams) -> DataFrame:
    names = p.labels or regime_labels(p.k)
    rows = [(names[i], names[j], float(p.trans[i, j])) for i in range(p.k) for j in range(p.k)]
    return spark.createDataFrame(rows, "from_state string, to_state string, prob double")


def save_hmm(spark: SparkSession, p: HmmParams, path: str) -> None:
    """Parameters as a one-row table."""
    body = {
        "start": p.start.tolist(), "trans": p.trans.tolist(), "means": p.means.tolist(), "covs": p.covs.tolist(), "labels": p.labels,
        "prep": None if p.prep is None else vars(p.prep), "log_likelihood": p.log_likelihood, "iterations": p.iterations, "converged": p.converged,
    }
    spark.createDataFrame([(json.dumps(body),)], "model string").write.mode("overwrite").parquet(path)


def load_hmm(spark: SparkSession, path: str) -> HmmParams:
    b = json.loads(spark.read.parquet(path).first()["model"])
    prep = None if b["prep"] is None else Prep(b["prep"]["cols"], {c: tuple(v) for c, v in b["prep"]["limits"].items()}, b["prep"]["mean"], b["prep"]["scale"])
    return HmmParams(*[np.array(b[n]) for n in ("start", "trans", "means", "covs")], prep, b["labels"], b["log_likelihood"], b["iterations"], b.get("converged", False))


# ---------------------------------------------------------------------------------------------------------
# One model per group: series, walk-forward window, fold. A task fits all groups it holds at once.


def _scaled(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Winsorised, filled and scaled by the limits and spread of ``ref``; a column without a value is 0."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # columns without a value
        lo, hi = np.nanpercentile(ref, 1, axis=0), np.nanpercentile(ref, 99, axis=0)
    c = np.nan_to_num(np.clip(ref, lo, hi))
    s = c.std(0)
    return (np.nan_to_num(np.clip(x, lo, hi)) - c.mean(0)) / np.where(s > 1e-4, s, 1.0)


def _raw(t: pa.Table, cols: Sequence[str]) -> np.ndarray:
    """Columns as one array of doubles; null is NaN."""
    return np.stack([t[c].cast(pa.float64()).to_numpy() for c in cols], axis=1)


def regimes_per_series(
    df: DataFrame, cols: Sequence[str], key: Sequence[str] = ("asset",), k: int = 3, max_iter: int = 100, order: str = "ts", smoothing: int = 5, tol: float = 1e-2,
    long_rows: int = 500_000, chunk_rows: int | None = None,
) -> DataFrame:
    """Fit and label every series with its own model, all in one job: ``key, ts, state, iterations, converged, label``.

    All rows of all series stay, however short; ``converged`` says whether the likelihood of a series settled within
    ``max_iter``. Series that are not ordered by DATE may hold any number of rows: those of more than ``long_rows``
    are cut into chunks of ``chunk_rows`` and fitted together, an iteration of all of them at a time.
    """
    d = df.select(*key, order, *cols)
    names = regime_labels(k)
    keep = [*key, order]
    schema = _kinds(d, keep) + ", state int, iterations int, converged boolean"

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        raw = _raw(t, cols)
        xs = [_scaled(raw[a:b], raw[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        fits = tm.fit_many(xs, k, max_iter, tol)
        path, size = np.concatenate(tm.paths_many(xs, fits.models)), np.diff(starts)
        out = t.select(keep)
        for name, v, kind in (("state", path, pa.int32()), ("iterations", np.repeat(fits.iterations, size), pa.int32()), ("converged", np.repeat(fits.converged, size), pa.bool_())):
            out = out.append_column(name, pa.array(v, kind))
        return out

    if is_bounded(d, order):
        out = map_groups(d, key, [order], run, schema, rows=20_000)
    else:
        sizes = checkpoint(d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")))
        short = d.join(sizes.filter(F.col("_n") <= long_rows).select(*key), list(key), "left_semi")
        out = map_groups(short, key, [order], run, schema, rows=20_000)
        if sizes.filter(F.col("_n") > long_rows).limit(1).count():
            from tidemark.operators.longfit import regimes_of_long_series

            long = d.join(sizes.filter(F.col("_n") > long_rows).select(*key), list(key), "left_semi")
            out = out.unionByName(regimes_of_long_series(long, cols, key, k, max_iter, order, tol, chunk_rows))
    out = smooth_mode(out, smoothing, key, "state", order, chunk_rows=None if is_bounded(d, order) else chunk_rows) if smoothing else out
    return out.withColumn("label", F.get(F.array(*[F.lit(x) for x in names]), F.col("state")))


def walk_forward_confidence(
    df: DataFrame, windows: DataFrame, cols: Sequence[str] = ("ret",), key: Sequence[str] = ("series",), k: int = 3, mapping: dict[int, float] | None = None,
    history: int = 63, min_rows: int = 21, max_iter: int = 50, order: str = "ts",
) -> DataFrame:
    """Per window: fit on its training rows, label its test rows (with ``history`` rows before them as context),
    and map states to confidence. ``windows`` is ``ts, window_id, role``; a group holds one window of one series.

    A window of fewer training rows without nulls than ``max(min_rows, history, 10)`` is not fitted: state, confidence,
    iterations and converged of its test rows are NULL.
    """
    from tidemark.operators.backtest import confidence_map

    d = df.select(*key, order, *cols).join(windows, order)
    keep = [c for c in d.columns if c not in (*cols, "role")]

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        raw, train = _raw(t, cols), np.array(t["role"].to_pylist()) == "train"
        tests, fits_on, contexts, pick = [], [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            known, test = raw[a:b][train[a:b]], a + np.flatnonzero(~train[a:b])
            tests.append(test)
            pick.append(len(test) > 0 and (~np.isnan(known).any(axis=1)).sum() >= max(min_rows, history, 10))
            if pick[-1]:
                fits_on.append(_scaled(known, known))
                contexts.append(_scaled(np.concatenate((known[-history:], raw[test])), known))
        n = sum(map(len, tests))
        state, its, done, fitted = np.zeros(n, "i4"), np.zeros(n, "i4"), np.zeros(n, bool), np.repeat(pick, [len(x) for x in tests]).astype(bool)
        if fits_on:
            fits = tm.fit_many(fits_on, k, max_iter)
            paths = tm.paths_many(contexts, fits.models)
            size = [len(x) for x, ok in zip(tests, pick) if ok]
            state[fitted] = np.concatenate([p[-m:] for p, m in zip(paths, size)])
            its[fitted], done[fitted] = np.repeat(fits.iterations, size), np.repeat(fits.converged, size)
        out = t.select(keep).take(pa.array(np.concatenate(tests)))
        for name, v in (("state", state), ("iterations", its), ("converged", done)):
            out = out.append_column(name, pa.array(v, mask=~fitted))
        return out

    out = map_groups(d, [*key, "window_id"], [order], run, _kinds(d, keep) + ", state int, iterations int, converged boolean", rows=20_000)
    known = confidence_map(out, mapping, k)
    return known.withColumn("confidence", F.when(F.col("state").isNotNull(), F.col("confidence")))


def ts_cross_validate(df: DataFrame, cols: Sequence[str], k: int = 3, n_splits: int = 5, key: Sequence[str] = ("series",), max_iter: int = 50, order: str = "ts") -> DataFrame:
    """Per expanding fold: share of test rows that keep the label of the row before (the first counts as a change).

    ``train_rows, test_rows, iterations, converged`` come with it; a fold without rows on either side has a null share.
    """
    from tidemark.operators.prep import time_series_folds

    d = time_series_folds(df.select(*key, order, *cols).dropna(), n_splits, key, order)
    head = [*key, "fold"]

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        raw, train = _raw(t, cols), np.array(t["role"].to_pylist()) == "train"
        parts = [(raw[a:b][train[a:b]], raw[a:b][~train[a:b]]) for a, b in zip(starts[:-1], starts[1:])]
        n = len(parts)
        known = np.array([len(x) > 0 and len(y) > 0 for x, y in parts])
        share, its, done = np.zeros(n), np.zeros(n, "i4"), np.zeros(n, bool)
        if known.any():
            fits = tm.fit_many([_scaled(x, x) for (x, _), ok in zip(parts, known) if ok], k, max_iter)
            paths = tm.paths_many([_scaled(y, x) for (x, y), ok in zip(parts, known) if ok], fits.models)
            share[known] = [1 - (1 + (p[1:] != p[:-1]).sum()) / len(p) for p in paths]
            its[known], done[known] = fits.iterations, fits.converged
        size = [pa.array([len(p[i]) for p in parts], pa.int64()) for i in (0, 1)]
        mask = ~known
        return _heads(t, starts, head, stability=pa.array(share, mask=mask), train_rows=size[0], test_rows=size[1], iterations=pa.array(its, mask=mask), converged=pa.array(done, mask=mask))

    return map_groups(d, head, [order], run, _kinds(d, head) + ", stability double, train_rows long, test_rows long, iterations int, converged boolean", rows=20_000)


def stability_report(df: DataFrame, p: HmmParams, cols: Sequence[str], key: Sequence[str] = ("series",), n_splits: int = 5, order: str = "ts") -> DataFrame:
    """Cross-validated stability next to likelihood criteria, persistence and mean duration of the labels.

    ``n_folds`` counts the folds that the mean is over.
    """
    from tidemark.operators.regime import average_duration, regime_persistence

    cv = ts_cross_validate(df, cols, p.k, n_splits, key, order=order).groupBy(*key).agg(
        F.avg("stability").alias("mean_stability"), F.stddev_pop("stability").alias("std_stability"), F.count("stability").alias("n_folds")
    )
    reg = checkpoint(predict_regimes(df, p, 5, key, order))
    out = cv.withColumn("stability_significant", F.col("mean_stability") > 0.7)
    for part in (information_criteria(df, p, key, order), regime_persistence(reg, key, "label", order), average_duration(reg, key, "label", order)):
        out = out.join(part, list(key))
    return out
