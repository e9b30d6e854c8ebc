"""Gaussian Markov models of many series at once: arrays with time first, a step of Python per time, not per row.

Series lie side by side, the longest first, so that at each time those still running are the first ones. They are the last
axis of all work arrays, so that the few states and features cost whole rows of an array and no short inner loops. A series
may be a chunk of a longer one: then it comes with what is known of the state before and after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np

#: Added to covariances; keeps them positive.
RIDGE = 0.01
#: Cells (times by series) of a work array that are handled at once: they stay in the cache.
CELLS = 16_384
#: What ``expected`` returns, in this order.
SUMS = ("ll", "n", "g0", "g", "gx", "gxx", "xi")


@dataclass(frozen=True)
class Models:
    """A model per series: ``start`` (S, K), ``trans`` (S, K, K), ``means`` (S, K, d), ``covs`` (S, K, d, d)."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def pick(self, at) -> Models:
        return Models(self.start[at], self.trans[at], self.means[at], self.covs[at])

    def put(self, at, m: Models) -> None:
        self.start[at], self.trans[at], self.means[at], self.covs[at] = m.start, m.trans, m.means, m.covs

    @staticmethod
    def same(p, n: int) -> Models:
        """``n`` times one model (anything with the four arrays)."""
        return Models(*[np.broadcast_to(a, (n, *a.shape)) for a in (p.start, p.trans, p.means, p.covs)])

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(len(self.start), -1) for a in (self.start, self.trans, self.means, self.covs)], axis=1)

    @staticmethod
    def from_flat(rows: np.ndarray, k: int, d: int) -> Models:
        cut = np.cumsum([k, k * k, k * d])
        s, t, m, c = np.split(rows, cut, axis=1)
        return Models(s, t.reshape(-1, k, k), m.reshape(-1, k, d), c.reshape(-1, k, d, d))


@dataclass(frozen=True)
class Stack:
    """``x`` (T, S, d) of series with ``n`` rows each, ``n`` falling; ``active[t]`` of them have a row at time ``t``.

    ``x`` is kept feature by feature, as ``planes`` (d, T, S).
    """

    x: np.ndarray
    n: np.ndarray
    active: np.ndarray

    @staticmethod
    def of(xs: Sequence[np.ndarray]) -> Stack:
        n = np.array([len(v) for v in xs])
        x = np.zeros((xs[0].shape[1], n[0], len(xs)))
        for i, v in enumerate(xs):
            x[:, : len(v), i] = v.T
        return Stack.of_bytes(n, x, len(x))

    @staticmethod
    def of_bytes(n: np.ndarray, x: np.ndarray, d: int) -> Stack:
        """From falling lengths and padded values in the order of ``planes``."""
        return Stack(x.reshape(d, n[0], len(n)).transpose(1, 2, 0), n, len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right"))

    @property
    def planes(self) -> np.ndarray:
        return np.ascontiguousarray(self.x.transpose(2, 0, 1))

    @property
    def blocks(self) -> list[slice]:
        """Spans of times of about ``CELLS`` cells."""
        step = max(1, CELLS // len(self.n))
        return [slice(t, t + step) for t in range(0, len(self.x), step)]

    @property
    def mask(self) -> np.ndarray:
        return np.arange(len(self.x))[:, None] < self.n

    def pick(self, at: np.ndarray) -> Stack:
        n = self.n[at]
        return Stack(self.planes[:, : n[0], at].transpose(1, 2, 0), n, len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right"))


def stacks(xs: Sequence[np.ndarray], cells: int = 400_000) -> Iterator[tuple[np.ndarray, Stack]]:
    """``(which, stack)``: series of like lengths together, so that less than half of a stack is padding."""
    order = np.argsort([-len(v) for v in xs], kind="stable")
    at = 0
    while at < len(order):
        n, to = len(xs[order[at]]), at + 1
        while to < len(order) and 2 * len(xs[order[to]]) > n and n * (to - at + 1) <= cells:
            to += 1
        yield order[at:to], Stack.of([xs[i] for i in order[at:to]])
        at = to


def densities(s: Stack, m: Models) -> np.ndarray:
    """Log densities (T, S, K) of all rows in all states."""
    return _densities(s, m).transpose(0, 2, 1)


def _densities(s: Stack, m: Models) -> np.ndarray:
    """Log densities (T, K, S)."""
    root = np.linalg.cholesky(m.covs)
    inv = np.ascontiguousarray(np.linalg.inv(root).transpose(1, 2, 3, 0))
    k, d = inv.shape[:2]
    shift = np.ascontiguousarray(np.log(np.diagonal(root, axis1=-2, axis2=-1)).sum(-1).T) + 0.5 * d * np.log(2 * np.pi)
    means, x = np.ascontiguousarray(m.means.transpose(1, 2, 0)), s.planes
    out = np.empty((len(s.x), k, len(s.n)))
    for t in s.blocks:
        for c in range(k):
            off = [x[j, t] - means[c, j] for j in range(d)]
            far = 0.0
            for i in range(d):
                z = inv[c, i, 0] * off[0]
                for j in range(1, i + 1):
                    z += inv[c, i, j] * off[j]
                far += z * z
            out[t, c] = -0.5 * far - shift[c]
    return out


def _log(a: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(a, 1e-300))


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass(frozen=True)
class Ends:
    """Logs of what is known of the state before (S, K) and after (S, K) each series; ``first`` (S) has nothing before."""

    before: np.ndarray
    after: np.ndarray
    first: np.ndarray

    @staticmethod
    def none(s: int, k: int) -> Ends:
        return Ends(np.zeros((s, k)), np.zeros((s, k)), np.ones(s, bool))

    def pick(self, at) -> Ends:
        return Ends(self.before[at], self.after[at], self.first[at])


def _weights(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(axis=1, keepdims=True)
    w = np.exp(logs - top)
    total = w.sum(axis=1, keepdims=True)
    return w / total, (top + np.log(total))[:, 0]


def _moves(m: Models):
    """Steps of state weights (K, A) of the first A series: forward in time and back."""
    if m.trans.strides[0] == 0:  # all have one model
        one = np.ascontiguousarray(m.trans[0])
        return (lambda v: one.T @ v), (lambda u: one @ u)
    a = np.ascontiguousarray(m.trans.transpose(1, 2, 0))
    return (lambda v: (v[:, None] * a[:, :, : v.shape[1]]).sum(0)), (lambda u: (a[:, :, : u.shape[1]] * u).sum(1))


def smooth(s: Stack, m: Models, ends: Ends):
    """Forward and backward weights (T, K, S), row densities and weights (K, S) before the first row, log likelihoods (S).

    Weights of a row are up to a factor; the likelihood is that of the whole series of which each is a chunk.
    """
    e = _densities(s, m)
    w0, offset = _weights(ends.before)
    ll, mask = np.where(ends.first, 0.0, offset), s.mask
    for t in s.blocks:
        top = e[t].max(1)
        e[t] = np.exp(e[t] - top[:, None])
        ll += np.where(mask[t], top, 0.0).sum(0)
    al, be, totals = np.zeros_like(e), np.zeros_like(e), np.ones(mask.shape)
    forward, back = _moves(m)
    v = np.where(ends.first, m.start.T, forward(np.ascontiguousarray(w0.T))) * e[0]
    for t, a in enumerate(s.active):
        if t:
            v = forward(v[:, :a]) * e[t, :, :a]
        total = np.maximum(v.sum(0), 1e-300, out=totals[t, :a])
        v /= total
        al[t, :, :a] = v
    for t in s.blocks:
        ll += np.log(totals[t]).sum(0)
    u, tail = _weights(ends.after)
    u = np.ascontiguousarray(u.T)
    for t in range(len(s.x) - 1, -1, -1):
        a = s.active[t]
        be[t, :, :a] = u[:, :a]
        step = back(e[t, :, :a] * u[:, :a])
        np.divide(step, step.sum(0), out=u[:, :a])
    every = np.arange(len(s.n))
    last = s.n - 1
    return al, be, e, w0.T, ll + tail + np.log((al[last, :, every] * be[last, :, every]).sum(1))


def probabilities(s: Stack, m: Models, ends: Ends) -> np.ndarray:
    al, be, *_ = smooth(s, m, ends)
    g = al * be
    total = g.sum(1, keepdims=True)
    return (g / np.where(total > 0, total, 1.0)).transpose(0, 2, 1)


def likelihoods(s: Stack, m: Models, ends: Ends) -> np.ndarray:
    return smooth(s, m, ends)[-1]


def expected(s: Stack, m: Models, ends: Ends) -> dict[str, np.ndarray]:
    """Sums per series that the maximisation needs. A transition into a chunk counts there, the one out of it does not."""
    al, be, e, w0, ll = smooth(s, m, ends)
    x, mask, (_, k, every) = s.planes, s.mask, al.shape
    d = len(x)
    mask[0] &= ~ends.first
    trans = np.ascontiguousarray(m.trans.transpose(1, 2, 0))
    g, gx, gxx, xi = np.zeros((k, every)), np.zeros((k, d, every)), np.zeros((k, d, d, every)), np.zeros((k, k, every))
    for t in s.blocks:
        w = al[t] * be[t]
        total = w.sum(1)
        w /= np.where(total > 0, total, 1.0)[:, None]
        if not t.start:
            g0 = w[0].copy()
        g += w.sum(0)
        for c in range(k):
            for i in range(d):
                wx = w[:, c] * x[i, t]
                gx[c, i] += wx.sum(0)
                for j in range(i + 1):
                    gxx[c, i, j] += (wx * x[j, t]).sum(0)
        prior = al[t.start - 1 : t.stop - 1] if t.start else np.concatenate((w0[None], al[: t.stop - 1]))
        prior, nxt = prior[: len(w)], e[t] * be[t]
        z = sum((sum(prior[:, i] * trans[i, j] for i in range(k)) * nxt[:, j] for j in range(k)))
        scaled = prior * np.where(mask[t], 1 / np.where(z > 0, z, 1.0), 0.0)[:, None]
        for i in range(k):
            xi[i] += (scaled[:, i, None] * nxt).sum(0)
    for i in range(d):
        for j in range(i):
            gxx[:, j, i] = gxx[:, i, j]
    return {
        "ll": np.where(ends.first, ll, 0.0), "n": s.n.astype(float), "g0": np.where(ends.first[:, None], g0.T, 0.0), "g": g.T,
        "gx": gx.transpose(2, 0, 1), "gxx": gxx.transpose(3, 0, 1, 2), "xi": (trans * xi).transpose(2, 0, 1),
    }


def maximised(e: dict[str, np.ndarray], m: Models) -> Models:
    """New models from the sums, one per series."""
    d = m.means.shape[2]
    g = np.maximum(e["g"], 1e-10)
    means = e["gx"] / g[..., None]
    scatter = e["gxx"] - g[..., None, None] * means[..., :, None] * means[..., None, :]
    covs = (scatter + RIDGE * np.eye(d)) / g[..., None, None]
    row = e["xi"].sum(2, keepdims=True)
    trans = np.where(row > 0, e["xi"] / np.where(row > 0, row, 1.0), m.trans)
    return Models(e["g0"] / e["g0"].sum(1, keepdims=True), trans, means, (covs + covs.swapaxes(2, 3)) / 2)


def best_paths(s: Stack, m: Models, ends: Ends) -> np.ndarray:
    """Most likely states (T, S); what lies behind the end of a series means nothing."""
    logs, move = densities(s, m), _log(m.trans)
    back = np.zeros(logs.shape, "i1")
    score = np.where(ends.first[:, None], _log(m.start), (ends.before[:, :, None] + move).max(1)) + logs[0]
    for t in range(1, len(logs)):
        a = s.active[t]
        step = score[:a, :, None] + move[:a]
        back[t, :a] = step.argmax(1)
        score[:a] = step.max(1) + logs[t, :a]
    path = np.zeros(logs.shape[:2], "i4")
    now, every = (score + ends.after).argmax(1), np.arange(len(s.n))
    for t in range(len(logs) - 1, -1, -1):
        a = s.active[t]
        path[t, :a] = now[:a]
        now[:a] = back[t, every[:a], now[:a]]
    return path


def effects(s: Stack, m: Models, first: np.ndarray, best: bool) -> np.ndarray:
    """Log effect (S, K, K) of each chunk: from the state before it to its last state, over all paths or the best."""
    logs, move = densities(s, m), _log(m.trans)
    k = move.shape[1]
    out = np.where(first[:, None, None], np.repeat(_log(m.start)[:, None, :], k, axis=1), move) + logs[0][:, None, :]
    if best:
        for t in range(1, len(logs)):
            a = s.active[t]
            out[:a] = (out[:a, :, :, None] + move[:a, None]).max(2) + logs[t, :a, None, :]
        return out
    top = logs.max(-1)
    e = np.exp(logs - top[..., None])
    scale = out.max((1, 2))
    w = np.exp(out - scale[:, None, None])
    for t in range(1, len(logs)):
        a = s.active[t]
        w[:a] = (w[:a] @ m.trans[:a]) * e[t, :a, None, :]
        total = w[:a].sum((1, 2))
        w[:a] /= total[:, None, None]
        scale[:a] += np.log(total) + top[t, :a]
    return _log(w) + scale[:, None, None]


# ---------------------------------------------------------------------------------------------------------
# Fitting


def initial(s: Stack, k: int) -> Models:
    """Bands of equal size by the distance of the first feature from its median, sticky moves, even start.

    A band without rows (series of fewer than ``k`` rows) starts from all rows of the series.
    """
    mask, d = s.mask, s.x.shape[2]
    far = np.abs(s.x[..., 0] - np.nanmedian(np.where(mask, s.x[..., 0], np.nan), axis=0))
    rank = np.argsort(np.argsort(np.where(mask, far, np.inf), axis=0, kind="stable"), axis=0, kind="stable")
    band = np.where(mask, rank * k // s.n, k)
    w = (band[..., None] == np.arange(k)).astype(float)
    w = np.where(w.sum(0) > 0, w, mask[..., None])
    n = w.sum(0)
    means = np.einsum("tsk,tsi->ski", w, s.x) / n[..., None]
    off = s.x[:, :, None, :] - means
    covs = np.einsum("tsk,tski,tskj->skij", w, off, off, optimize=True) / np.maximum(n - 1, 1)[..., None, None] + RIDGE * np.eye(d)
    trans = np.ones((k, k)) + np.eye(k)
    every = len(s.n)
    return Models(np.full((every, k), 1 / k), np.tile(trans / trans.sum(1, keepdims=True), (every, 1, 1)), means, covs)


def ordered(m: Models) -> Models:
    """States by the variance of the first feature: state 0 is the calmest."""
    o = np.argsort(m.covs[:, :, 0, 0], axis=1, kind="stable")
    s = np.arange(len(o))[:, None]
    return Models(m.start[s, o], m.trans[s[..., None], o[:, :, None], o[:, None, :]], m.means[s, o], m.covs[s, o])


@dataclass(frozen=True)
class Fits:
    """Models of many series, their likelihoods, iterations used, and whether the likelihood had settled."""

    models: Models
    log_likelihood: np.ndarray
    iterations: np.ndarray
    converged: np.ndarray


def fit_stack(s: Stack, k: int, max_iter: int, tol: float = 1e-2) -> Fits:
    """Expectation and maximisation of all series of a stack; a series that has settled leaves the work."""
    models = initial(s, k)
    every = len(s.n)
    out = Fits(models, np.full(every, -np.inf), np.zeros(every, "i4"), np.zeros(every, bool))
    at, work, now = np.arange(every), s, models.pick(np.arange(every))
    last = np.full(every, -np.inf)
    for i in range(1, max_iter + 1):
        e = expected(work, now, Ends.none(len(at), k))
        now = maximised(e, now)
        out.models.put(at, now)
        out.log_likelihood[at], out.iterations[at] = e["ll"], i
        done = e["ll"] - last < tol
        out.converged[at[done]] = True
        go = np.flatnonzero(~done)
        if not len(go):
            break
        last = e["ll"]
        if len(go) < len(at):
            at, work, now, last = at[go], work.pick(go), now.pick(go), last[go]
    return replace(out, models=ordered(out.models))


def fit_many(xs: Sequence[np.ndarray], k: int, max_iter: int, tol: float = 1e-2) -> Fits:
    """A model for each series, in the order given."""
    n, d = len(xs), xs[0].shape[1]
    out = Fits(Models(np.empty((n, k)), np.empty((n, k, k)), np.empty((n, k, d)), np.empty((n, k, d, d))), np.empty(n), np.empty(n, "i4"), np.empty(n, bool))
    for at, s in stacks(xs):
        f = fit_stack(s, k, max_iter, tol)
        out.models.put(at, f.models)
        out.log_likelihood[at], out.iterations[at], out.converged[at] = f.log_likelihood, f.iterations, f.converged
    return out


def paths_many(xs: Sequence[np.ndarray], m: Models, ends: Ends | None = None) -> list[np.ndarray]:
    """Most likely states of each series under its model."""
    out: list[np.ndarray] = [np.empty(0, "i4")] * len(xs)
    ends = ends or Ends.none(len(xs), m.start.shape[1])
    for at, s in stacks(xs):
        p = best_paths(s, m.pick(at), ends.pick(at))
        for j, i in enumerate(at):
            out[i] = p[: s.n[j], j]
    return out
