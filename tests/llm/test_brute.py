"""Operators against plain versions, on generated texts with planted repeats."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidemark.llm import chunks, components, jaccard, language, mixing, packing, quality, substring, suffix, token_files, topk, toxicity
from tidemark.llm.catalog import vocabulary
from tidemark.llm.tokens import Encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "é", "st", "re"]) for _ in range(r.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(3, 15))).capitalize() + r.choice(".!?")
    text = lambda: "".join(sentence() + r.choice([" ", "\n"]) for _ in range(r.randint(1, 25)))
    out = [text() for _ in range(120)]
    for _ in range(60):  # near copies and shared passages
        t = r.choice(out).split(" ")
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = word()
        a, b = r.choice(out), r.choice(out)
        out += [" ".join(t), a[: len(a) // 2] + b[len(b) // 3 :]]
    out += [out[3]] * 5 + [" ".join(["same"] * 40), "A\n\nA\nB\n#1 *2"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def roots(n, links):
    p = list(range(n))

    def f(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in links:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return [f(i) for i in range(n)]


@pytest.mark.parametrize("block", [1_000_000, 800])
def test_similar_documents(docs, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = []
    for t in texts:
        w = WORDS.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = jaccard.similar_documents(docs).toPandas().set_index("doc_id")
    assert [got.component_id[i] for i in range(len(texts))] == want
    assert [got.n_shingles[i] for i in range(len(texts))] == [len(s) for s in sets]
    assert len(set(want)) < len(texts) - 10


def test_repeated_strings(docs, texts):
    got = suffix.repeated_strings(docs).toPandas().set_index("doc_id")
    seen = set()
    for i, t in enumerate(texts):
        b = t.encode()
        gone, new = np.zeros(len(b), bool), set()
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = True
            else:
                new.add(b[k : k + 50])
        seen |= new
        assert bytes(np.frombuffer(b, "u1")[~gone]) == got.kept[i], i
        assert got.n_removed[i] == gone.sum()


def test_stretches_of_one_anchor_are_told_apart(spark):
    """So many neighbours of one phrase that 28 bits of their hashes repeat; no string of 50 bytes does."""
    r, n = random.Random(6), 60_000
    code = chunks.byte_codes()

    def gram(b):
        h, size = code[np.frombuffer(b, "u1")], 1
        while size < 16:
            h, size = chunks.joined(h, size, h, size), 2 * size
        eight = chunks.joined(*[chunks.joined(*[chunks.joined(code[np.frombuffer(b, "u1")], 1, code[np.frombuffer(b, "u1")], 1), 2] * 2), 4] * 2)
        return chunks.mixed(chunks.joined(h, 16, eight, 8))[0]

    letters = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    phrase = min((letters(24) for _ in range(3000)), key=lambda w: gram(w.encode()))  # an anchor wherever it occurs
    rows = [(i, letters(26) + phrase + letters(26)) for i in range(n)]
    rows.append((n, letters(40) + rows[7][1][3:70] + letters(40)))
    got = suffix.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter("n_removed > 0").toPandas()
    assert got.doc_id.tolist() == [n] and got.n_removed.tolist() == [67]


def test_anchors_alike_by_chance_repeat_nothing():
    keys, docs = [np.array([1, 5, 9], "u8"), np.array([5, 7], "u8")], [np.array([0, 1, 1]), np.array([2, 2])]
    leads = [np.array([3, 3, 8], "u8"), np.array([3, 4], "u8")]
    got = suffix.judge_stretches(keys, docs, leads)
    assert [g.tolist() for g in got] == [[suffix.LOOK_UP, suffix.LOOK_UP, suffix.UNIQUE], [suffix.REPEAT, suffix.UNIQUE]]


def test_substrings(docs, texts):
    got = substring.remove_repeats(docs).select("row.doc_id", "text").toPandas().set_index("doc_id").text
    seen, want = {}, []
    for i, t in enumerate(texts):
        s = substring.sentences(t)
        for a, b in substring.runs([x[3] for x in s], 3, 20, 40):
            assert b - a >= 2 or sum(x[3] for x in s[a : b + 1]) >= 40
            seen.setdefault(" ".join(x[2] for x in s[a : b + 1]), (i, a, b))
    for i, t in enumerate(texts):
        s, gone = substring.sentences(t), set()
        for a, b in substring.runs([x[3] for x in s], 3, 20, 40):
            if seen[" ".join(x[2] for x in s[a : b + 1])] != (i, a, b):
                gone.update(range(s[a][0], s[b][1]))
        want.append("".join(c for k, c in enumerate(t) if k not in gone))
    assert [got[i] for i in range(len(texts))] == want


def test_quality(docs, texts):
    got = quality.quality_rules(docs).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert got.base_failed[i] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_packing_is_tight_and_whole(docs, texts):
    got = packing.best_fit_pack(docs, vocabulary(), capacity=128).toPandas()
    enc = Encoder(vocabulary())
    for i, g in got.sort_values("piece").groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in g.ids])
        assert (ids == np.append(enc.encode([texts[i]])[0], 2)).all()
        assert (g.length.to_numpy()[1:] == 128).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 128) * 1.03 + 1


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
@settings(max_examples=60, deadline=None)
def test_plan_fills_slots_once(counts):
    used = {}
    for length, lo, hi, per, seq, off in packing.plan_sequences(counts, 40):
        for r in range(lo, hi):
            s, o = seq + (r - lo) // per, off + (r - lo) % per * length
            assert not used.setdefault(s, set()) & set(range(o, o + length)) and o + length <= 40
            used[s] |= set(range(o, o + length))
        counts = {**counts, length: counts[length] - (hi - lo)}
    assert not any(counts.values())


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values):
    ids = np.array(values, "<u4")
    data, start = token_files.pack_blocks(ids)
    assert (token_files.unpack_blocks(data, start)[: len(ids)] == ids).all()
    if len(start) > 1:
        assert (token_files.unpack_blocks(data, start[1:])[: len(ids) - 128] == ids[128:]).all()


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_encoder_equals_library(texts):
    e = Encoder(vocabulary())
    for got, want in zip(e.encode(texts), e.tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_encoder_equals_library_on_added_tokens():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(vocabulary())
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    texts = [x for a in added for x in (f"one{a}two", a, f" {a}{a} ", f"é {a[:-1]}", f"{a}漢")] + ["plain words"]
    assert added
    for got, want in zip(Encoder(vocabulary()).encode(texts), fresh.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.REMEMBERED", 7)
    e, r = Encoder(vocabulary()), random.Random(1)
    texts = [" ".join(r.choice(["ab", "cd", "efg", "h", "ijk", "lm", "nop", "q"]) for _ in range(r.randint(1, 9))) for _ in range(200)]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, i) for i in range(501, 560)]
    got = components.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).toPandas().set_index("node").component
    want = roots(600, pairs)
    assert got.to_dict() == {i: want[i] for p in pairs for i in p}


def test_top_products(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(400, 6)) * g.choice([0.2, 1, 5], 400)[:, None]
    v[100:140] = v[100] + g.normal(size=(40, 6)) * 0.001
    q = np.floor(256 * v.astype("f4").astype("f8")).astype("i8")
    got = topk.top_products(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), "vec_id % 10 = 0", bucket=64, block=10).toPandas()
    for i, rows in got.sort_values("rank").groupby("query_id"):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:5]
        assert rows.vec_id.tolist() == best and rows.score.tolist() == s[best].tolist()
    assert got.query_id.nunique() == 40


@pytest.mark.parametrize("dim", [1, 2, 3, 8])
def test_top_products_near_axes(spark, dim):
    g = np.random.default_rng(dim)
    v = g.normal(size=(600, dim)) * g.choice([0.02, 0.2], 600)[:, None]
    v[np.arange(600), g.integers(0, dim, 600)] += g.choice([-1, 1], 600)
    v *= (g.choice([1, 1.1, 1.3, 4], 600) * g.uniform(0.95, 1, 600))[:, None]
    q = np.floor(256 * v.astype("f4").astype("f8")).astype("i8")
    got = topk.top_products(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), "vec_id % 5 = 0", bucket=32, block=20).toPandas()
    for i, rows in got.sort_values("rank").groupby("query_id"):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(600), -s)) if j != i][:5]
        assert rows.vec_id.tolist() == best and rows.score.tolist() == s[best].tolist()
    assert got.query_id.nunique() == 120


def test_blocks_go_only_to_buckets_within_reach(spark):
    lengths = spark.createDataFrame([(2, b, 0, 100.0 / (b + 1)) for b in range(10)] + [(3, 0, 0, 1.0)], "dim long, bucket long, first long, longest double")
    asked = spark.createDataFrame([(2, 0, 60.0), (2, 0, 49.0), (2, 1, 25.0), (2, 2, 0.0), (3, 2, 2.0)], "dim long, block long, reach double")
    got = {(r["dim"], r["block"]): r["upto"] for r in topk.reached(asked, lengths).collect()}
    assert got == {(2, 0): 1, (2, 1): 3, (2, 2): 9}


def test_products_stop_at_the_shortest_useful_vector(monkeypatch):
    rows, plain = [], topk.products
    monkeypatch.setattr(topk, "products", lambda q, p: rows.append(len(p)) or plain(q, p))
    p = np.array([[0, n] for n in range(200, 0, -1)])
    (got,) = topk.search_bucket(np.array([-1]), np.array([[30, 10]]), np.array([1500]), np.arange(200), p, 5)
    assert got[1].tolist() == [0, 1, 2, 3, 4] and rows[0] < 200


def test_coordinate_ranges_reach_the_axis():
    """Thresholds below the query's own coordinate: vectors on the axis, and beyond it, count."""
    for sign in (1, -1):
        q, p = np.array([[sign * 950, 312]]), np.array([[sign * 1000, 0], [sign * 950, 312], [0, 1000], [sign * 700, -714]])
        scores = p @ q[0]
        for t in (0.72, 0.75, 0.85, 0.94, 0.96):
            least = int(t * np.linalg.norm(q) * 1000)
            (got,) = topk.search_bucket(np.array([9]), q, np.array([least]), np.arange(4), p, 4)
            want = [j for j in np.argsort(-scores, kind="stable") if scores[j] >= least]
            assert got[1].tolist() == want and got[2].tolist() == scores[want].tolist()


def test_mix(docs, texts):
    got = mixing.mix_plan(docs).toPandas()
    sizes = got.groupby("source")["size"].sum()
    targets = got.groupby("source").target.first()
    w, free, left = dict(zip(sorted(sizes.index), (1, 2, 3, 1))), set(sizes.index), float(sizes.sum())
    want = {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        want.update({s: 3.0 * sizes[s] if s in full else share[s] for s in (full or free)})
        left -= sum(3.0 * sizes[s] for s in full)
        free = free - full if full else set()
    assert {s: pytest.approx(v) for s, v in want.items()} == targets.to_dict()
    assert abs(got.groupby("source").taken.sum() - targets).max() <= 2 * got["size"].max()
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix_plan(docs.repartition(3)).toPandas().set_index("doc_id").taken
    assert (got.set_index("doc_id").taken == again[got.doc_id].to_numpy()).all()


def test_language_held_out(spark, sf):
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(d, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = language.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").filter("crc32(string(doc_id)) % 4 = 2").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert len(model.families) == 2


def test_toxicity_finds_planted_words():
    r = random.Random(4)
    plain = lambda: " ".join("".join(r.choice(["th", "er", "on", "an", "st", "re", "in"]) for _ in range(r.randint(1, 4))) for _ in range(80))
    bad = lambda: " ".join(w for x in plain().split() for w in ([x, r.choice(["zlurgh", "vrokk", "quampf"])] if r.random() < 0.04 else [x]))
    rows = [(bad(), 1) if i % 3 == 0 else (plain(), 0) for i in range(600)]
    rows = [(t, int(any(w in t for w in ("zlurgh", "vrokk", "quampf")))) for t, _ in rows]
    model = toxicity.fit(*zip(*rows[:400], strict=True))
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in rows[400:]]) > 0.9


def test_pipeline_stages(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, at, "").toPandas()
        if name == "best_fit_packing":
            assert rows.groupby("sequence_id").length.sum().max() <= 1024
            break
        assert list(rows.columns) == docs.columns and len(rows)
        at = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
