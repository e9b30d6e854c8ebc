"""Regime labels and probabilities: labelling by volatility, smoothing, statistics, fusion of two models.

``regimes`` frames hold ``key, ts, label``; probability frames hold ``key, ts, p`` with one array per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import ROOT_YEAR, cumulative_return, rolling_std
from tidemark.operators.prep import YEAR
from tidemark.plans.attach import attach, attach_series
from tidemark.plans.ranks import attach_quantiles
from tidemark.plans.series import running, series

KEY = ("series",)
LABELS = ("Low Vol", "Medium Vol", "High Vol")


def regime_labels(k: int) -> list[str]:
    """Names of k states: by volatility for up to three, numbered beyond."""
    return list(LABELS[:k]) if k <= 3 else [f"Regime {i}" for i in range(k)]


def vol_regime(returns: DataFrame, n: int = 21, labels: Sequence[str] = LABELS, key: Sequence[str] = ("asset",), col="ret", order="ts") -> DataFrame:
    """Label rows by the quantile band of their rolling deviation within the series."""
    d = rolling_std(returns, col, n, key, "vol", order)
    k = len(labels)
    d = attach_quantiles(d, "vol", [i / k for i in range(1, k)], key, "_q", order)
    label = F.when(F.col("vol").isNull(), None)
    for i in range(k - 1):
        label = label.when(F.col("vol") <= F.col("_q")[i], labels[i])
    return d.withColumn("label", label.otherwise(labels[-1])).drop("_q")


def smooth_mode(df: DataFrame, w: int, key: Sequence[str] = KEY, col="label", order="ts", out: str | None = None, chunk_rows=None) -> DataFrame:
    """Most frequent value of the 2w+1 rows around each row, smallest on ties; the first and last w rows keep theirs."""
    s = series(df, key, order, lookback=w, lookahead=w, chunk_rows=chunk_rows)
    around = s.span(-w, w)
    full = s.shared("around", F.count(F.lit(1)).over(around)) == 2 * w + 1
    mode = s.shared("mode", F.mode(col, True).over(around))
    return s.add({out or col: F.when(full, mode).otherwise(F.col(col))})


def _changed(s, col: str) -> Column:
    prev = s.shared(f"prev_{col}", F.lag(col).over(s.ordered()))
    return F.when(prev.isNull(), 0).otherwise((F.col(col) != prev).cast("int"))


def with_changes(regimes: DataFrame, key=KEY, col="label", order="ts", chunk_rows=None) -> DataFrame:
    """Adds ``changed``: 1 where the label differs from the row before, 0 on the first row."""
    s = series(regimes, key, order, lookback=1, chunk_rows=chunk_rows)
    return s.add({"changed": _changed(s, col)})


def with_runs(regimes: DataFrame, key=KEY, col="label", order="ts", chunk_rows=None) -> DataFrame:
    """Adds ``changed`` and ``run``, the number of changes up to the row."""
    return running(with_changes(regimes, key, col, order, chunk_rows), key, {"run": ("sum", "changed")}, order, chunk_rows=chunk_rows)


def transition_matrix(regimes: DataFrame, key=KEY, col="label", order="ts", chunk_rows=None) -> DataFrame:
    """Share of rows that move from one label to the next: ``key, from_state, to_state, count, prob``."""
    s = series(regimes, key, order, lookahead=1, chunk_rows=chunk_rows)
    d = s.add({"_to": F.lead(col).over(s.ordered())}).filter(F.col("_to").isNotNull())
    c = d.groupBy(*key, F.col(col).alias("from_state"), F.col("_to").alias("to_state")).agg(F.count(F.lit(1)).alias("count"))
    return attach(c, [*key, "from_state"], _all=F.sum("count")).withColumn("prob", F.col("count") / F.col("_all")).drop("_all")


def regime_stats(returns: DataFrame, regimes: DataFrame, labels: Sequence[str] = LABELS, key=KEY, col="ret", order="ts") -> DataFrame:
    """Per label: annual mean and deviation, frequency, Sharpe ratio; a label that never occurs has frequency 0."""
    d = returns.join(regimes.select(*key, order, "label"), [*key, order])
    m, s = F.avg(col) * YEAR, F.stddev_samp(col) * ROOT_YEAR
    g = d.groupBy(*key, "label").agg(
        m.alias("mean_return"), s.alias("volatility"), F.count(F.lit(1)).alias("_n"), F.try_divide(m, s).alias("sharpe")
    )
    total = g.groupBy(*key).agg(F.sum("_n").alias("_all"))
    grid = total.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    g = grid.join(g, [*key, "label"], "left")
    return g.select(*key, "label", "mean_return", "volatility", (F.coalesce("_n", F.lit(0)) / F.col("_all")).alias("frequency"), "sharpe")


def information_ratio_by_regime(returns, regimes, labels=LABELS, key=KEY, col="ret", order="ts") -> DataFrame:
    return regime_stats(returns, regimes, labels, key, col, order).select(*key, "label", F.col("sharpe").alias("information_ratio"))


def regime_persistence(regimes: DataFrame, key=KEY, col="label", order="ts") -> DataFrame:
    """1 - changes / rows."""
    d = with_changes(regimes, key, col, order)
    return d.groupBy(*key).agg((1 - F.sum("changed") / F.count(F.lit(1))).alias("persistence"))


def regime_runs(regimes: DataFrame, key=KEY, col="label", order="ts", chunk_rows=None) -> DataFrame:
    """One row per run of equal labels: ``run, label, start_ts, end_ts, length``."""
    d = with_runs(regimes, key, col, order, chunk_rows)
    return d.groupBy(*key, "run").agg(
        F.first(col).alias("label"), F.min(order).alias("start_ts"), F.max(order).alias("end_ts"), F.count(F.lit(1)).alias("length")
    )


def average_duration(regimes: DataFrame, key=KEY, col="label", order="ts") -> DataFrame:
    return regime_runs(regimes, key, col, order).groupBy(*key).agg(F.avg("length").alias("avg_duration"))


def regime_path_features(returns: DataFrame, regimes: DataFrame, key=KEY, col="ret", order="ts") -> DataFrame:
    """Transitions (the first row counts as one), length of the current run, and drawdown within it."""
    d = with_runs(regimes.select(*key, order, "label").join(returns.select(*key, order, col), [*key, order]), key, "label", order)
    d = attach_series(d, key, order, _last=F.max("run"))
    total = d.groupBy(*key).agg((F.max("run") + 1).alias("transition_count"), F.max_by("label", order).alias("current_regime"))
    now = cumulative_return(d.filter("run = _last").drop("run", "changed"), col, key, order)
    now = now.groupBy(*key).agg(
        F.count(F.lit(1)).alias("time_since_last_transition"), F.count(F.lit(1)).alias("current_regime_duration"),
        F.min(F.col("cum") / F.col("peak") - 1).alias("drawdown_since_last_regime"),
    )
    return total.join(now, list(key))


def confidence_metrics(history: DataFrame, transitions: DataFrame, window: int = 63, key=KEY, order="ts") -> DataFrame:
    """Over the last rows of ``history(key, ts, label, confidence)``: stability (the first row counts as a
    change), mean confidence, share of the current label, and the model's probability of staying in it."""
    from tidemark.operators.cross import last_n

    d = with_changes(last_n(history, window, key, order), key, "label", order)
    d = attach_series(d, key, order, _now=F.max_by("label", order))
    a = d.groupBy(*key).agg(
        (1 - (F.sum("changed") + 1) / F.count(F.lit(1))).alias("stability"),
        F.avg("confidence").alias("average_confidence"),
        F.avg((F.col("label") == F.col("_now")).cast("int")).alias("persistence"),
        F.count(F.lit(1)).alias("sample_size"),
        F.first("_now").alias("current_regime"),
    )
    on = [k for k in key if k in transitions.columns]
    stay = transitions.filter("from_state = to_state").select(*on, F.col("from_state").alias("current_regime"), F.col("prob").alias("transition_stability"))
    return a.join(stay, [*on, "current_regime"], "left")


# ---------------------------------------------------------------------------------------------------------
# Fusion of two probability frames

EPS = 1e-8


def _normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def _entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(x))


def _clip(p: Column) -> Column:
    return F.transform(p, lambda x: F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0)))


def _both(p_a: DataFrame, p_b: DataFrame, key, order) -> DataFrame:
    return p_a.select(*key, order, F.col("p").alias("_a")).join(p_b.select(*key, order, F.col("p").alias("_b")), [*key, order])


def fuse_entropy(p_a: DataFrame, p_b: DataFrame, key=KEY, order="ts") -> DataFrame:
    """Mix two distributions per row by confidence over entropy: adds ``p`` and the weight ``w`` of the first.

    The entropy is floored at 0.02 and the weight kept in [0.05, 0.95].
    """
    d = _both(p_a, p_b, key, order).select(*key, order, _normalised(F.col("_a")).alias("_a"), _normalised(F.col("_b")).alias("_b"))
    score = lambda c: F.array_max(_clip(F.col(c))) / F.greatest(_entropy(_clip(F.col(c))), F.lit(0.02))
    d = d.withColumns({"_sa": score("_a"), "_sb": score("_b")})
    d = d.withColumn("w", F.least(F.greatest(F.col("_sa") / (F.col("_sa") + F.col("_sb") + EPS), F.lit(0.05)), F.lit(0.95)))
    w = F.col("w")
    return d.withColumn("p", F.zip_with("_a", "_b", lambda a, b: w * a + (1 - w) * b)).select(*key, order, "p", "w")


def fuse_product(p_a: DataFrame, p_b: DataFrame, alpha: float = 1.0, beta: float = 1.0, key=KEY, order="ts") -> DataFrame:
    """Product of experts: p_a^alpha * p_b^beta, normalised."""
    d = _both(p_a, p_b, key, order)
    raw = F.zip_with(_clip(F.col("_a")), _clip(F.col("_b")), lambda a, b: F.pow(a, F.lit(alpha)) * F.pow(b, F.lit(beta)))
    return d.withColumn("_r", raw).select(*key, order, _normalised(F.col("_r")).alias("p"))


def global_model_weights(p_a: DataFrame, p_b: DataFrame, key=KEY, order="ts", by: Sequence[str] = ()) -> DataFrame:
    """One weight per model: mean confidence over mean entropy, the latter in [0.1, 2]."""
    d = _both(p_a, p_b, key, order)

    def score(c):
        ent = -F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x * F.log(x + EPS))
        return F.avg(F.array_max(c)) / F.least(F.greatest(F.avg(ent), F.lit(0.1)), F.lit(2.0))

    a = d.groupBy(*by).agg(score("_a").alias("_sa"), score("_b").alias("_sb"))
    wa = F.when(F.col("_sa") + F.col("_sb") > 0, F.col("_sa") / (F.col("_sa") + F.col("_sb"))).otherwise(0.5)
    return a.select(*by, wa.alias("weight_a"), (1 - wa).alias("weight_b"))


def _valid(p: Column) -> Column:
    """No NULL inside and a sum above 1e-5."""
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.aggregate(p, F.lit(0.0), lambda a, x: a + x) > 1e-5)


def arg_max(p: Column) -> Column:
    """0-based position of the largest probability, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def ensemble_probabilities(p_a: DataFrame, p_b: DataFrame | None = None, key=KEY, order="ts") -> DataFrame:
    """Fused probabilities where both models are valid; those of the first model when there is no second."""
    if p_b is None:
        return p_a.select(*key, order, "p")
    return fuse_entropy(p_a.filter(_valid(F.col("p"))), p_b.filter(_valid(F.col("p"))), key, order).select(*key, order, "p")


def fuse_labels(p_a: DataFrame, p_b: DataFrame | None, labels: Sequence[str] = LABELS, mode="entropy", alpha=1.0, beta=1.0, key=KEY, order="ts") -> DataFrame:
    """Most probable label of the fused rows; of the first model where the second is missing or invalid."""
    names = F.array(*[F.lit(x) for x in labels])
    base = p_a.select(*key, order, F.col("p").alias("_base"))
    if p_b is None:
        return base.select(*key, order, F.get(names, arg_max(F.col("_base"))).alias("label"))
    ok_a, ok_b = p_a.filter(_valid(F.col("p"))), p_b.filter(_valid(F.col("p")))
    fused = fuse_entropy(ok_a, ok_b, key, order) if mode == "entropy" else fuse_product(ok_a, ok_b, alpha, beta, key, order)
    d = base.join(fused.select(*key, order, "p"), [*key, order], "left")
    return d.select(*key, order, F.get(names, arg_max(F.coalesce("p", "_base"))).alias("label"))


# ---------------------------------------------------------------------------------------------------------
# Sequences and baselines


def sequence_windows(df: DataFrame, cols: Sequence[str], length: int = 20, key=("asset",), order="ts", out="x", chunk_rows=None) -> DataFrame:
    """The ``length`` rows before each row as one flat array; rows without a full history are dropped."""
    s = series(df, key, order, lookback=length, chunk_rows=chunk_rows)
    past = s.span(-length, -1)
    seq = s.shared("seq", F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(past))
    return s.add({out: F.when(F.size(seq) == length, F.flatten(seq))}).filter(F.col(out).isNotNull())


def moving_average_baseline(returns: DataFrame, n: int = 10, key=KEY, col="ret", order="ts", out="baseline") -> DataFrame:
    """Rolling mean from the first row on."""
    s = series(returns, key, order, lookback=n - 1)
    return s.add({out: s.shared("ma", F.avg(col).over(s.rows(n)))})


def compare_to_benchmark(
    returns: DataFrame, kind: str = "moving_average", regimes: DataFrame | None = None, key=KEY, col="ret", order="ts", seed: int = 42,
    alternative: str = "greater",
) -> DataFrame:
    """Mean return against a baseline and the paired t test of the difference.

    ``moving_average``: 10-row mean. ``hmm``: the return only on days outside the last label, which needs
    ``regimes``. ``random``: the return on a random half of the days, drawn from a hash of the row.
    """
    from tidemark.operators.validate import paired_t_test

    if kind == "moving_average":
        d = moving_average_baseline(returns, 10, key, col, order)
    elif kind == "hmm":
        if regimes is None:
            raise ValueError("kind='hmm' needs regimes")
        d = returns.join(regimes.select(*key, order, "label"), [*key, order])
        d = d.withColumn("baseline", F.when(F.col("label") == LABELS[-1], 0.0).otherwise(F.col(col)))
    elif kind == "random":
        d = returns.withColumn("baseline", F.when(F.pmod(F.xxhash64(F.lit(seed), *key, order), F.lit(2)) == 0, F.col(col)).otherwise(0.0))
    else:
        raise ValueError(f"unknown benchmark {kind!r}")
    t = paired_t_test(d, col, "baseline", key, alternative=alternative)
    means = d.groupBy(*key).agg(F.avg(col).alias("mean_return"), F.avg("baseline").alias("baseline_mean_return"))
    return means.join(t, list(key))
