"""Collocations, SentencePiece ids and whitening against plain versions, and on edge rows."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import phrases, pieces, whitening
from tidemark.llm.catalog import QUERIES, vocabulary

MODEL = "piece_bpe_32k.model"


# -- collocations -----------------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, share, top):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        longer = [b for (la, v), b in found.items() if la == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in longer):
            continue
        cuts = [(1000000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, f in out.items() for i, (s, a, p, left, right) in enumerate(sorted(f)[:top]))


def words_of(seed, n):
    r = random.Random(seed)
    few = ["a", "b", "The", "of", "é", "x1", "\x1f", "\xa0y", "…"]
    text = lambda: "".join(r.choice(few) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! "]) for _ in range(r.randint(0, 40)))
    return [(text(), r.choice(["en", "en", "fr", None])) for _ in range(n)] + [(None, "en"), ("", "de"), ("one passage that many texts hold as it is", "en")] * 6


@pytest.mark.parametrize("longest,least,share,top", [(3, 10, 50, 2000), (4, 3, 80, 7), (2, 1, 50, 50)])
def test_collocations(spark, monkeypatch, longest, least, share, top):
    rows = words_of(longest, 500 if least == 10 else 80)
    real = phrases.word_chunks
    monkeypatch.setattr(phrases, "word_chunks", lambda d, **k: real(d, most=400, **k))  # many chunks, texts cut between pieces
    docs = spark.createDataFrame([(t, la, 1, 2, "x") for t, la in rows], "text string, lang string, phrase int, words int, chunk string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, longest, least, share, top).collect())
    assert got == plain_collocations(rows, longest, least, share, top) and got


def test_rare_hashes_only_choose(spark, monkeypatch):
    """All hashes equal: everything is sent, the result stays."""
    rows = words_of(9, 30)
    monkeypatch.setattr(phrases, "mixed", lambda h: h & np.uint64(3))
    g = phrases.ChunkGraph("en", phrases.zstandard.compress(b"a b c. a b. c a b c"), 3)
    assert len(g.keys()[0]) <= 4
    sent = list(g.rows([np.ones(len(lv.count), bool) for lv in g.levels]))
    assert dict(zip(sent[2][1], sent[2][2].tolist())) in ({b"a b c": 2, b"c a b": 1}, {b"a b c": 2, b"c a b": 1})
    assert {k: sum(w) for k, _, w in sent} == {1: 3, 2: 3, 3: 3}  # nine words: three edges, three ends of two, three of one
    assert plain_collocations(rows, 3, 5, 50, 9)


def test_unary_path():
    g = phrases.ChunkGraph("en", phrases.zstandard.compress(b"a b c d e f. a b c d e f. x b c"), 3)
    (k, paths, weights) = list(g.rows([np.ones(len(lv.count), bool) for lv in g.levels]))[-1]
    assert k == 3 and dict(zip(paths, weights.tolist())) in ({b"a b c": 2, b"b c d e f": 2, b"x b c": 1},)


def test_collocations_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), (" .\t", "en")], "text string, lang string")).count() == 0


# -- SentencePiece ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL)), pieces.PieceModel(vocabulary(MODEL))


def same(both, texts):
    library, own = both
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab inthe.,\n▁é漢", max_size=80)), max_size=8))
def test_pieces_equal_library(both, texts):
    same(both, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_pieces_hard_texts(both, monkeypatch):
    r = random.Random(4)
    texts = [None, "", " ", "a" * 3000, "ab" * 2000, "\n" * 50, " " * 70 + "x", "<s>a</s><unk><0x41>", "a▁b", "\x00", "�", "😀漢字 ½"]
    texts += ["".join(r.choice("abehtins") for _ in range(r.randint(1, 900))) for _ in range(60)]
    texts += ["".join(r.choice(["aba", "ab", "in", "ing", " ", "▁▁", "é"]) for _ in range(300)) for _ in range(60)]
    same(both, texts)
    monkeypatch.setattr(pieces, "STRETCH", 37)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "LONGEST", 3)
    same(both, texts)
    assert len(both[1].known) <= 2000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(both, ids):
    assert both[1].decode(np.array(ids, "u4")) == both[0].decode(ids)


def test_better_pairs_first():
    """A merge that gives rise to a better pair has its turn first: merging all places at once would differ."""
    m = pieces.PieceModel.__new__(pieces.PieceModel)
    a, b, ab, aba = 0, 1, 2, 3
    m.rank, m.joins = np.array([9, 9, 5, 1], "i4"), pieces.PairTable({(a, b): ab, (ab, a): aba})
    got = m.merge_rounds(np.array([a, b, a, b]), np.array([False, False, False, True]))
    assert got[got >= 0].tolist() == [aba, b]


@pytest.mark.parametrize("full", [True, False])
def test_pieces_edges(make, both, full):
    rows = [(1, "The cat.", "en", "a"), (1, "The cat.", "en", "a"), (None, None, None, None), (2, "", None, None), (3, "word " * 30_000, "en", "b")]
    docs = make(rows if full else []).withColumnRenamed("row", "ids").withColumnRenamed("key", "decoded")
    got = pieces.encode(docs, vocabulary(MODEL), decoded=True)
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(got, vocabulary(MODEL)).collect()}
    got = got.collect()
    assert len(got) == (len(rows) if full else 0)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        assert r["decoded"] == text == back[r["doc_id"]] and np.frombuffer(r["ids"], "<u4").tolist() == both[0].encode(text, add_bos=True, add_eos=True) and r["n_tokens"] == len(r["ids"]) // 4


# -- whitening --------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 5), st.sampled_from([1, 3, 1000, 2**33, 2**49]), st.randoms())
def test_cross_products(rows, dim, size, r):
    x = np.array([[r.randint(-size, size) for _ in range(dim)] for _ in range(rows)], "i8")
    sums, products = whitening.cross_products(x)
    big = x.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist()
    assert products.tolist() == np.where(np.triu(np.ones((dim, dim), bool)), big.T @ big, 0).tolist()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, deviation string, n int").repartition(3)


def test_whitening(spark):
    r = np.random.default_rng(1)
    mix = r.normal(size=(12, 12))
    x = (r.normal(size=(400, 12)) @ mix).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[8].tolist())]
    dropped = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] * 12), (903, [None] * 12), (904, []), (905, [1.0])]
    got = whitening.whiten(vectors(spark, rows + dropped)).toPandas()
    whole = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, sums = len(whole), [sum(c) for c in zip(*whole)]
    assert len(got) == 8 * n and (got.n == n).all()
    v = np.array([[float(Fraction(n * sum(a[i] * a[j] for a in whole) - sums[i] * sums[j], n * n)) for j in range(12)] for i in range(12)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    z = (np.array(whole) - np.array(sums) / n) @ axes[:, :8] / np.sqrt(e[:8])
    for c in range(8):
        part = got[(got.component == c + 1) & got.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id")
        own = part.whitened.to_numpy()
        sign = np.sign(own @ z[:400, c])
        assert np.abs(own * sign - z[:400, c]).max() < 1e-7
        assert part.explained.iloc[0] == pytest.approx(e[c] / np.trace(v), rel=1e-9)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(w, sums)) for (i, _), w in zip(rows, whole)}
    assert {int(i): int(d) for i, d in zip(got.vec_id.fillna(-1), got.deviation)} == {(-1 if i is None else i): d for i, d in want.items()}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9 and got.vec_id.isna().sum() == 8


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    flat = whitening.whiten(vectors(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and all(r["identity_error"] < 1e-12 for r in flat)
    far = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0]), (4, [0.0, -2.0])])).collect()
    assert len(far) == 8 and all(r["identity_error"] < 1e-4 for r in far) and {r["vec_id"]: int(r["deviation"]) for r in far}[3] == 16 * (0**2 + 1792**2) + 0


@pytest.mark.parametrize("name", ["op11_collocations", "op12_sentence_pieces", "op13_whitening"])
def test_registered(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
