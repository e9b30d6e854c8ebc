"""One Markov model per series for series too long for a task, fitted together.

Rows are placed by series and chunk once. An iteration runs over the chunks of all series that have not settled: effects
of chunks, their products along the tree, sums per chunk with the model of its series, sums per series, and one grouped
maximisation. Models travel as one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hmm import _kinds, _lists, expected_sums, over_series, place, sums_from
from tidemark.plans import timemajor as tm
from tidemark.plans.ranks import attach_quantiles
from tidemark.plans.series import CHUNK, SEQ, number_rows
from tidemark.session import checkpoint


def _scaled(d: DataFrame, cols: Sequence[str], key: Sequence[str], order: str) -> DataFrame:
    """Adds ``x``: winsorised, filled and scaled within each series, as for short series."""
    for c in cols:
        v = F.col(c).cast("double")
        d = d.withColumn(c, F.when(~F.isnan(v), v))
        d = attach_quantiles(d, c, [0.01, 0.99], key, "_q", order)
        low, high = F.col("_q")[0], F.col("_q")[1]
        d = d.withColumn(c, F.coalesce(F.when(F.col(c).isNotNull(), F.greatest(F.least(c, high), low)), F.lit(0.0))).drop("_q")
    d = checkpoint(d)
    moments = d.groupBy(*key).agg(*[a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    d = d.join(moments, list(key))
    return d.withColumn("x", F.array(*[(F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-4, F.col(f"_s_{c}")).otherwise(1.0) for c in cols])).drop(*[f"_{p}_{c}" for c in cols for p in "ms"])


def _bands(d: DataFrame, key: Sequence[str], order: str, k: int) -> DataFrame:
    """Adds ``_band``: that of the distance of the first feature from its median."""
    d = attach_quantiles(d.withColumn("_x0", F.col("x")[0]), "_x0", [0.5], key, "_q", order)
    d = d.withColumn("_far", F.abs(F.col("_x0") - F.col("_q")[0])).drop("_q")
    d = attach_quantiles(d, "_far", [i / k for i in range(1, k)], key, "_q", order)
    band = sum([(F.col("_far") > F.col("_q")[i]).cast("int") for i in range(k - 1)], F.lit(0))
    return d.withColumn("_band", band).drop("_q", "_far", "_x0")


def _starts(d: DataFrame, key: Sequence[str], k: int, dim: int) -> DataFrame:
    """``key, _model``: means and covariances of the bands."""
    x = [F.col("x")[i] for i in range(dim)]
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    g = d.groupBy(*key, "_band").agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.avg(v) for v in x]).alias("mean"), F.array(*[F.coalesce(F.covar_samp(x[i], x[j]), F.lit(0.0)) for i, j in pairs]).alias("cov")).alias("s"))
    g = g.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_band", "s"))).alias("bands"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            models = []
            for bands in b.column("bands").to_pylist():
                bands = dict(bands)
                m = tm.Models(np.full((1, k), 1 / k), (np.ones((1, k, k)) + np.eye(k)) / (k + 1), np.zeros((1, k, dim)), np.tile(np.eye(dim), (1, k, 1, 1)))
                for s, v in bands.items():
                    m.means[0, s] = v["mean"]
                    for (i, j), c in zip(pairs, v["cov"]):
                        m.covs[0, s, i, j] = m.covs[0, s, j, i] = c + (tm.RIDGE if i == j else 0.0)
                models.append(m.flat()[0])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in key], _lists(np.array(models))], names=[*key, "_model"])

    return g.mapInArrow(run, _kinds(g, key) + ", _model array<double>")


def regimes_of_long_series(df: DataFrame, cols: Sequence[str], key: Sequence[str], k: int, max_iter: int, order: str, tol: float = 1e-2, chunk_rows: int | None = None) -> DataFrame:
    """``key, ts, state, iterations, converged``; see ``regimes_per_series``.

    The start differs from that of short series only where distances from the median tie at a band's edge.
    """
    key, dim = list(key), len(cols)
    d = number_rows(df, key, order, chunked=True)
    d = _bands(checkpoint(_scaled(d, cols, key, order)), key, order, k)
    d = place(d.select(*key, order, SEQ, "x", "_band"), key, order, chunk_rows or 100_000)
    chunks = checkpoint(d.select(*key, CHUNK).distinct())
    now = _starts(d, key, k, dim).withColumns({"_last": F.lit(float("-inf")), "iterations": F.lit(0), "converged": F.lit(False)})
    now, done = checkpoint(now), None
    kinds = _kinds(d, key)
    n_sums = 2 + 2 * k + k * dim * (1 + dim) + k * k

    def sums(t, starts, xs, m, ends):
        rows = expected_sums(xs, m, ends)
        return pa.table({**{c: t[c].take(pa.array(starts[:-1])) for c in key}, **{f"s{i}": rows[:, i] for i in range(n_sums)}})

    def maximise(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(f"s{i}").to_numpy() for i in range(n_sums)], axis=1)
            e = sums_from(rows, k, dim)
            old = tm.Models.from_flat(b.column("_model").flatten().to_numpy().reshape(b.num_rows, -1), k, dim)
            settled = e["ll"] - b.column("_last").to_numpy() < tol
            cols_ = [*[b.column(c) for c in key], _lists(tm.maximised(e, old).flat()), pa.array(e["ll"]), pa.array(b.column("iterations").to_numpy() + 1, pa.int32()), pa.array(settled)]
            yield pa.RecordBatch.from_arrays(cols_, names=[*key, "_model", "_last", "iterations", "converged"])

    schema = f"{kinds}, _model array<double>, _last double, iterations int, converged boolean"
    for _ in range(max_iter):
        rows = d.drop("_band").join(chunks.join(now.select(*key, "_model"), key), [*key, CHUNK])
        s = over_series(rows, key, None, sums, kinds + "".join(f", s{i} double" for i in range(n_sums)), order, k=k)
        s = s.groupBy(*key).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n_sums)]).join(now, key)
        now = checkpoint(s.mapInArrow(maximise, schema))
        settled = now.filter("converged")
        done = settled if done is None else done.unionByName(settled)
        now = now.filter("not converged")
        if not now.limit(1).count():
            break
    models = now if done is None else checkpoint(done.unionByName(now))

    def calm_first(batches):
        for b in batches:
            if b.num_rows:
                m = tm.ordered(tm.Models.from_flat(b.column("_model").flatten().to_numpy().reshape(b.num_rows, -1), k, dim))
                yield pa.RecordBatch.from_arrays([_lists(m.flat()) if c == "_model" else b.column(c) for c in b.schema.names], names=b.schema.names)

    models = checkpoint(models.mapInArrow(calm_first, schema))

    def decode(t, starts, xs, m, ends):
        path = tm.paths_many(xs, m, ends)
        return t.select([*key, order, "iterations", "converged"]).append_column("state", pa.array(np.concatenate(path), pa.int32()))

    rows = d.drop("_band").join(chunks.join(models.drop("_last"), key), [*key, CHUNK])
    out = over_series(rows, key, None, decode, _kinds(d, [*key, order]) + ", iterations int, converged boolean, state int", order, True, k)
    return out.select(*key, order, "state", "iterations", "converged")
