"""Results and steps that once took more disk or time than their rows need."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import daily

from tidemark.operators import cross
from tidemark.plans import pairs, strong


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(6)
    x = {f"s{i:02d}": np.where(rng.random(50) < 0.2, np.nan, rng.normal(size=50)) for i in range(14)} | {"flat": np.ones(50)}
    return pd.DataFrame(x), daily(spark, {a: {"ret": v} for a, v in x.items()}).dropna()


def counted(spark, d):
    """``d``, and a count of the rows of it that tasks have made."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for t in batches:
            seen.add(t.num_rows)
            yield t

    return d.mapInArrow(run, d.schema), seen


def block(x):
    """A written block of the columns of a frame."""
    rows = [{"m": a, "days": list(np.flatnonzero(v.notna()).astype("i4")), "xs": list(v.dropna())} for a, v in x.items()]
    kind = pa.list_(pa.struct([("m", pa.string()), ("days", pa.list_(pa.int32())), ("xs", pa.list_(pa.float64()))]))
    return pairs.Block(pa.array([rows], kind)[0])


@pytest.mark.parametrize("wide", [5, 2048])
def test_correlations_make_their_input_once_and_leave_a_task_in_order(spark, gappy, monkeypatch, wide):
    x, d = gappy
    monkeypatch.setattr(pairs, "WIDE", wide)
    made, seen = counted(spark, d)
    found = [tuple(r) for r in cross.correlation(made).collect()]
    assert seen.value == d.count()  # not made again to count the series or to cut the blocks
    want, k = x.corr(), x.notna().astype(int)
    assert len(found) == len({r[:2] for r in found}) == 225
    for a, b, c, n in found:
        assert n == (k[a] * k[b]).sum() and (c is None if "flat" in (a, b) else c == pytest.approx(want.loc[a, b], abs=1e-9))
    if wide > len(k):
        corr = [c for _, _, c, _ in found if c is not None]
        assert corr == sorted(corr) and found[-1][2] is None


def test_pieces_of_pairs_are_followed_by_the_other_way_round(gappy, monkeypatch):
    monkeypatch.setattr(pairs, "PIECE", 10)
    monkeypatch.setattr(pairs, "NEAR", 4)
    x = gappy[0].iloc[:, :6]
    a, b = block(x.iloc[:, :3]), block(x.iloc[:, 3:])
    out = [pa.RecordBatch.from_arrays(c, names=["a", "b", "corr", "n"]).to_pylist() for c in pairs._block_correlations(a, b, True)]
    assert [len(rows) for rows in out] == [18]
    ways = [(r["a"] < r["b"]) for r in out[0]]
    assert ways == [True] * 4 + [False] * 4 + [True] * 4 + [False] * 4 + [True, False]
    assert {(r["a"], r["b"]): r["corr"] for r in out[0]} == pytest.approx({(p, q): x.corr().loc[p, q] for i in x.columns[:3] for j in x.columns[3:] for p, q in ((i, j), (j, i))})


@pytest.fixture
def odd():
    """Series with gaps: noise, followers of one series by many degrees and both signs, copies, and values of very different size."""
    rng = np.random.default_rng(9)
    t, lead = 80, rng.normal(size=80)
    x = {f"n{i}": rng.normal(size=t) for i in range(9)}
    x |= {f"f{i}": (-1) ** i * lead + rng.normal(size=t) * i / 4 for i in range(9)}
    x |= {"twin1": x["n3"].copy(), "twin2": x["n3"].copy(), "mirror": -3 * x["f2"], "flat": np.full(t, 0.1), "step": np.where(np.arange(t) < 40, 1.0, 1.0 + 1e-12)}
    x |= {"far": 1e6 + lead, "small": 1e-9 * lead, "large": 1e9 * x["n5"] - 1e9, "peak": np.where(np.arange(t) == 7, 1e8, lead), "endless": np.where(np.arange(t) == 3, np.inf, lead)}
    d = pd.DataFrame(x)
    gaps = rng.random(d.shape) < 0.25
    gaps[:, d.columns.get_loc("twin1")] = gaps[:, d.columns.get_loc("twin2")] = gaps[:, d.columns.get_loc("n3")]
    gaps[:, d.columns.get_loc("n8")] = np.arange(t) > 10  # too short
    return d.mask(gaps)


def compared(x, a, b, threshold, least=20):
    """Size, names and dates of the strong pairs of two lists of columns, from each pair alone."""
    out = {}
    for i, p in enumerate(a):
        for q in b[i + 1 :] if a == b else b:
            both = x[[p, q]].dropna()
            u, v = (both[c].to_numpy() for c in (p, q))
            if len(both) < least or np.isinf(x[[p, q]].to_numpy()).any() or min(np.ptp(u) / np.abs(u).max(), np.ptp(v) / np.abs(v).max()) < 1e-7:
                continue
            c = np.corrcoef(u, v)[0, 1]
            if abs(c) >= threshold:
                out[tuple(sorted((p, q)))] = c, len(both)
    return out


@pytest.mark.parametrize("dense", [0.0, 1.0])
@pytest.mark.parametrize("threshold", [0.15, 0.9])
@pytest.mark.parametrize("own", [True, False])
def test_single_precision_loses_no_strong_pair(odd, monkeypatch, dense, threshold, own):
    for name, v in (("STRIP", 4), ("TILE", 6), ("EXACT", 5), ("DENSE", dense)):
        monkeypatch.setattr(strong, name, v)
    a = list(odd.columns) if own else list(odd.columns[::2])
    b = a if own else list(odd.columns[1::2])
    left, right = block(odd[a]), block(odd[b])
    want = compared(odd, a, b, threshold)
    assert len(want) > 3
    rows = [r for t in strong._strong(left, left if own else right, own, threshold, 20) for r in t.to_pylist()]
    got = {(r["a"], r["b"]): (r["corr"], r["n"]) for r in rows}
    assert set(got) == set(want) and len(rows) == len(got)
    for k, (c, n) in want.items():
        assert got[k] == (pytest.approx(c, abs=1e-7), n)
    for top in (1, 3):
        (t,) = strong._strongest(left, left if own else right, own, threshold, 20, top)
        best = {}
        for r in t.to_pylist():
            assert (r["corr"], r["n"]) == (pytest.approx(got[tuple(sorted((r["asset"], r["other"])))][0], abs=1e-9), got[tuple(sorted((r["asset"], r["other"])))][1])
            best.setdefault(r["asset"], []).append((-round(abs(r["corr"]), 9), r["other"]))
        full = {}
        for (p, q), (c, _) in got.items():
            full.setdefault(p, []).append((-round(abs(c), 9), q))
            full.setdefault(q, []).append((-round(abs(c), 9), p))
        assert {p: sorted(c for c, _ in v) for p, v in best.items()} == {p: [c for c, _ in sorted(v)[:top]] for p, v in full.items()}
        assert all(len(set(v)) == len(v) and set(v) <= set(full[p]) for p, v in best.items())
        if own and top == 3:
            assert [q for _, q in sorted(best["n3"])[:2]] == ["twin1", "twin2"]  # ties to the smaller name


def test_only_the_strongest_leave_a_task(spark):
    rng = np.random.default_rng(8)
    lead = rng.normal(size=60)
    x = {f"s{i:02d}": lead + rng.normal(size=60) * 0.5 for i in range(24)}  # every pair is a strong one
    d, seen = counted(spark, daily(spark, {a: {"ret": np.where(rng.random(60) < 0.1, np.nan, v)} for a, v in x.items()}).dropna())
    sides = strong.strong_pairs(d, 0.15, block=12, top=2).collect()
    blocks = max(len({r["other"] for r in sides if r["asset"] == a}) for a in x) // 2 + 1
    assert len(sides) <= 24 * 2 * blocks < 24 * 23
    assert seen.value == d.count()  # the series are made once
    best = cross.strong_pairs(d, 0.15, top=2, block=12).collect()
    assert len(best) == 48 and {(r["asset"], r["other"]) for r in best} <= {(r["asset"], r["other"]) for r in sides}


def test_blocks_are_as_wide_as_a_task_can_hold_and_enough_for_all_cores():
    assert strong.width(360_000, 360, 12) == strong.WIDEST and strong.width(360_000, 2500, 12) == pairs.WIDE
    assert strong.width(60_000, 100_000, 8) == pairs.WIDE and strong.width(6_000, 360, 8) == 750 and strong.width(5, 3, 200) == strong.NARROWEST
