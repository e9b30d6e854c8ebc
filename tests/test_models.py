"""Markov models against brute force; chunks against whole series."""

import itertools

import numpy as np
import pandas as pd
import pytest
from helpers import by, daily, same, stamped
from pyspark.sql import functions as F

from tidemark.operators import classify, hmm
from tidemark.operators import regime as rg
from tidemark.plans import timemajor as tm

RNG = np.random.default_rng(11)
PARAMS = hmm.HmmParams(
    np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0, 0.0], [1.0, -1.0]]),
    np.array([[[0.5, 0.1], [0.1, 0.4]], [[2.0, 0.0], [0.0, 1.5]]]), hmm.Prep(["u", "v"], {"u": (-9.0, 9.0), "v": (-9.0, 9.0)}, [0.0, 0.0], [1.0, 1.0]), ["Low Vol", "High Vol"],
)


def brute(x, p):
    """All paths: best one, state probabilities, log likelihood."""
    b = hmm.log_density(x, p)
    paths = list(itertools.product(range(p.k), repeat=len(x)))
    score = np.array([np.log(p.start[q[0]]) + sum(np.log(p.trans[i, j]) for i, j in zip(q, q[1:])) + sum(b[t, s] for t, s in enumerate(q)) for q in paths])
    w = np.exp(score - score.max())
    prob = np.zeros((len(x), p.k))
    for q, v in zip(paths, w):
        for t, s in enumerate(q):
            prob[t, s] += v
    return list(paths[int(score.argmax())]), prob / w.sum(), float(np.log(w.sum()) + score.max())


@pytest.fixture(scope="module")
def df(spark):
    x = RNG.normal(size=(10, 2)) + np.repeat([[0, 0], [1.5, -1.5]], 5, axis=0)
    return x, daily(spark, {"a": {"u": x[:, 0], "v": x[:, 1]}}).cache()


@pytest.mark.parametrize("chunk", [None, 3, 4])
def test_decode_against_all_paths(df, chunk):
    x, d = df
    d = d if chunk is None else stamped(d)
    path, prob, ll = brute(x, PARAMS)
    kw = dict(key=["asset"], chunk_rows=chunk)
    assert by(hmm.predict_regimes(d, PARAMS, 0, **kw), "state") == path
    got = np.array(by(hmm.predict_proba(d, PARAMS, **kw), "p"))
    np.testing.assert_allclose(got, prob, atol=1e-10)
    np.testing.assert_allclose(got.sum(1), 1, atol=1e-12)
    c = hmm.information_criteria(d, PARAMS, **kw).first()
    same([c["log_likelihood"], c["aic"]], [ll, -2 * ll + 2 * (4 - 1 + 4)])


@pytest.mark.parametrize("best", [False, True])
@pytest.mark.parametrize("fan", [2, 3, 256])
def test_tree_of_chunks_equals_the_whole(spark, fan, best):
    """Series of one to eleven chunks: ends from the tree, sums and paths from chunks, against uncut series."""
    rng = np.random.default_rng(fan)
    series = {f"s{n}": rng.normal(size=(3 * n + 1, 2)) for n in range(11)}
    rows, cut = [], []
    for name, x in series.items():
        parts = [x[i : i + 3] for i in range(0, len(x), 3)]
        for c, s in enumerate(parts):
            m = tm.effects(tm.Stack.of([s]), tm.Models.same(PARAMS, 1), np.array([c == 0]), best)[0]
            rows.append((name, c, m.ravel().tolist()))
            cut.append((name, c, s))
    ms = spark.createDataFrame(rows, "series string, _chunk long, m array<double>").repartition(3)
    got = {(r["series"], r["_chunk"]): (r["before"], r["after"]) for r in hmm.state_ends(ms, ["series"], 2, best, fan).collect()}
    assert len(got) == len(cut) and all((got[n, c][0] is None) == (c == 0) for n, c, _ in cut)
    ends = tm.Ends(np.array([got[n, c][0] or [0.0, 0.0] for n, c, _ in cut]), np.array([got[n, c][1] for n, c, _ in cut]), np.array([c == 0 for _, c, _ in cut]))
    xs, names = [x for *_, x in cut], np.array([n for n, *_ in cut])
    whole = list(series.values())
    if best:
        paths = tm.paths_many(xs, tm.Models.same(PARAMS, len(xs)), ends)
        for name, want in zip(series, tm.paths_many(whole, tm.Models.same(PARAMS, len(whole)))):
            assert np.concatenate([p for p, n in zip(paths, names) if n == name]).tolist() == want.tolist()
    else:
        want = hmm.expected_sums(whole, tm.Models.same(PARAMS, len(whole)), tm.Ends.none(len(whole), 2))
        parts = hmm.expected_sums(xs, tm.Models.same(PARAMS, len(xs)), ends)
        for i, name in enumerate(series):
            np.testing.assert_allclose(parts[names == name].sum(0), want[i], atol=1e-8)


def plain_fit(x, k, max_iter, tol=1e-2):
    """One series, one row at a time."""
    far = np.argsort(np.argsort(np.abs(x[:, 0] - np.median(x[:, 0])), kind="stable"), kind="stable") * k // len(x)
    pick = [x[far == s] if (far == s).any() else x for s in range(k)]
    means, covs = np.array([v.mean(0) for v in pick]), np.array([(v - v.mean(0)).T @ (v - v.mean(0)) / max(len(v) - 1, 1) + 0.01 * np.eye(x.shape[1]) for v in pick])
    start, trans, last = np.full(k, 1 / k), (np.ones((k, k)) + np.eye(k)) / (k + 1), -np.inf
    for it in range(1, max_iter + 1):
        p = hmm.HmmParams(start, trans, means, covs)
        e = np.exp(hmm.log_density(x, p))
        al, be = np.empty_like(e), np.ones_like(e)
        for t in range(len(x)):
            al[t] = (start if t == 0 else al[t - 1] @ trans) * e[t]
        for t in range(len(x) - 2, -1, -1):
            be[t] = trans @ (e[t + 1] * be[t + 1])
        like = al[-1].sum()
        g, xi = al * be / like, sum(np.outer(al[t], e[t + 1] * be[t + 1]) * trans / like for t in range(len(x) - 1)) if len(x) > 1 else np.zeros((k, k))
        start, n = g[0], np.maximum(g.sum(0), 1e-10)
        means = g.T @ x / n[:, None]
        covs = np.array([((x.T * g[:, s]) @ x - n[s] * np.outer(means[s], means[s]) + 0.01 * np.eye(x.shape[1])) / n[s] for s in range(k)])
        trans = np.where(xi.sum(1, keepdims=True) > 0, xi / np.maximum(xi.sum(1, keepdims=True), 1e-300), trans)
        if np.log(like) - last < tol:
            return trans, means, covs, it, True
        last = np.log(like)
    return trans, means, covs, max_iter, False


def test_many_fits_equal_single_ones():
    """Series of all lengths down to one row, fitted side by side: each as if alone."""
    rng = np.random.default_rng(2)
    xs = [rng.normal(size=(n, 2)) * np.where(np.arange(n) % 40 < 20, 0.3, 2.0)[:, None] for n in (60, 1, 45, 2, 3, 44, 80, 7, 60)]
    for most in (3, 40):
        f = tm.fit_many(xs, 2, most)
        for i, x in enumerate(xs):
            trans, means, covs, it, done = plain_fit(x, 2, most)
            o = np.argsort(covs[:, 0, 0], kind="stable")
            if abs(np.diff(covs[o, 0, 0])[0]) < 1e-9 and abs(means[o] - f.models.means[i]).max() > 1e-6:  # equal variances: either order
                o = o[::-1]
            assert (f.iterations[i], f.converged[i]) == (it, done)
            np.testing.assert_allclose(f.models.means[i], means[o], atol=1e-6)
            np.testing.assert_allclose(f.models.covs[i], covs[o], atol=1e-6)
            np.testing.assert_allclose(f.models.trans[i], trans[np.ix_(o, o)], atol=1e-6)


def test_a_model_per_series(spark):
    """All rows of all series come back, with nulls, one row, constants and time stamps; chunks give what whole series give."""
    rng = np.random.default_rng(5)
    wild = rng.normal(size=240) * np.where(np.arange(240) % 80 < 40, 0.3, 2.0)
    cols = {"a": wild, "b": wild[::-1].copy(), "one": wild[:1], "few": wild[:5], "flat": np.ones(50)}
    d = daily(spark, {n: {"u": x, "w": pd.Series(np.abs(x)).rolling(5, center=True, min_periods=1).mean().to_numpy()} for n, x in cols.items()})
    d = d.withColumn("u", F.when(F.col("asset") != "few", F.col("u")))  # a feature without a value
    want = {(r["asset"], r["ts"]): r for r in hmm.regimes_per_series(d, ["u", "w"], ["asset"], 2, smoothing=0).collect()}
    assert len(want) == d.count() and all(r["state"] is not None and r["converged"] and r["label"] for r in want.values())
    assert np.mean([want["a", t]["state"] == (i % 80 >= 40) for i, t in enumerate(sorted(t for a, t in want if a == "a"))]) > 0.85
    got = hmm.regimes_per_series(stamped(d), ["u", "w"], ["asset"], 2, smoothing=0, long_rows=100, chunk_rows=50).collect()
    assert len(got) == len(want)
    assert all(want[r["asset"], r["ts"].date()]["state"] == r["state"] and want[r["asset"], r["ts"].date()]["iterations"] == r["iterations"] for r in got)
    none = hmm.regimes_per_series(d.limit(0), ["u"], ["asset"], 2)
    assert none.count() == 0 and hmm.regimes_per_series(stamped(d.limit(0)), ["u"], ["asset"], 2).count() == 0


def test_fit_finds_calm_and_wild(spark, monkeypatch):
    s = np.repeat([0, 1, 0, 1], 60)
    x = RNG.normal(size=240) * np.where(s == 0, 0.3, 2.0)
    w = pd.Series(np.abs(x)).rolling(5, center=True, min_periods=1).mean().to_numpy()
    d = daily(spark, {"a": {"u": x, "w": w}, "b": {"u": x[::-1].copy(), "w": w[::-1].copy()}})
    cols = ["u", "w"]
    p2, p8 = hmm.fit_hmm(d, cols, ["asset"], 2, max_iter=2), hmm.fit_hmm(d, cols, ["asset"], 2, max_iter=8)
    assert p8.log_likelihood >= p2.log_likelihood - 1e-6
    assert p8.covs[0, 0, 0] < p8.covs[1, 0, 0]
    got = by(hmm.predict_regimes(d, p8, 3, ["asset"]), "state")
    assert np.mean(np.array(got) == s) > 0.9
    assert p8.iterations <= 8 and not p2.converged and hmm.fit_hmm(d, cols, ["asset"], 2).converged
    own = by(hmm.regimes_per_series(d, cols, ["asset"], 2), "state")
    assert np.mean(np.array(own) == s) > 0.9
    monkeypatch.setattr(hmm, "kmeans_init", lambda *_: PARAMS)  # clusters depend on how rows are dealt out
    plans = [hmm.fit_hmm(d, cols, ["asset"], 2, max_iter=5, small_rows=0), hmm.fit_hmm(stamped(d), cols, ["asset"], 2, max_iter=5, chunk_rows=50)]
    whole = hmm.fit_hmm(d, cols, ["asset"], 2, max_iter=5)
    for q in plans:  # stacks, chunks: the same sums as in one task
        assert q.iterations == whole.iterations
        np.testing.assert_allclose(q.means, whole.means, atol=1e-8)
        np.testing.assert_allclose(q.trans, whole.trans, atol=1e-8)
        assert abs(q.log_likelihood - whole.log_likelihood) < 1e-6
    with pytest.raises(ValueError):
        hmm.fit_hmm(d, ["missing"], ["asset"], 2)


def test_save_and_load(spark, tmp_path):
    hmm.save_hmm(spark, PARAMS, str(tmp_path / "m"))
    q = hmm.load_hmm(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(q.covs, PARAMS.covs)
    assert q.prep == PARAMS.prep and q.labels == PARAMS.labels


def test_fusion_limits_and_fallback(spark):
    rows = [("a", 1, [1.0, 0.0], [0.5, 0.5]), ("a", 2, [0.6, 0.4], None), ("a", 3, [0.2, 0.8], [None, 0.5]), ("a", 4, [0.0, 0.0], [0.3, 0.7])]
    d = spark.createDataFrame(rows, "series string, ts int, x array<double>, y array<double>")
    a, b = d.select("series", "ts", F.col("x").alias("p")), d.select("series", "ts", F.col("y").alias("p"))
    lab = {r["ts"]: r["label"] for r in rg.fuse_labels(a, b, ["lo", "hi"]).collect()}
    assert lab == {1: "lo", 2: "lo", 3: "hi", 4: "lo"}
    w = rg.fuse_entropy(a.filter("ts = 1"), b.filter("ts = 1")).first()
    assert w["w"] == 0.95 and abs(sum(w["p"]) - 1) < 1e-12


def test_classifier_save_and_load(spark, tmp_path):
    x = np.sin(np.arange(120) / 9)
    seq = rg.sequence_windows(daily(spark, {"a": {"v": x}}), ["v"], 5).withColumn("state", (F.col("v") > 0).cast("int"))
    for hidden in (None, [4]):
        model, _ = classify.fit_regime_classifier(seq, 2, hidden, max_iter=5)
        classify.save_classifier(spark, model, str(tmp_path / "c"), 5, ["lo", "hi"])
        again, length, labels = classify.load_classifier(spark, str(tmp_path / "c"))
        assert (length, labels) == (5, ["lo", "hi"])
        assert by(classify.classifier_proba(seq, again), "p") == by(classify.classifier_proba(seq, model), "p")


def test_classifier_and_forecast(spark):
    x = np.sin(np.arange(200) / 9)
    d = daily(spark, {"a": {"v": x}, "b": {"v": -x}})
    seq = rg.sequence_windows(d, ["v"], 5).withColumn("state", (F.col("v") > 0).cast("int"))
    model, acc = classify.fit_regime_classifier(seq, 2, max_iter=20)
    assert acc > 0.9
    p = classify.predict_latest(seq, model)
    assert p.count() == 2 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in p.collect())
    f = {r["asset"]: r for r in classify.vol_forecast_interval(seq, "v", 5, 20).collect()}
    assert abs(f["a"]["predicted_mean"] - x[-1]) < 0.05 and f["a"]["predicted_std"] < 0.05
