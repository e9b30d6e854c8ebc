"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator on texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, mixing, packing, quality, substring, suffix, token_files, topk, toxicity
from tidemark.llm.catalog import vocabulary
from tidemark.llm.common import work_path

LONG = " ".join(f"word{i % 977} of a long text." for i in range(20_000))
ROWS = [
    (1, "The cat sat on the mat. It was a very warm day there. Everybody in the house was glad about it all.", "en", "a"),
    (2, "The cat sat on the mat. It was a very warm day there. Everybody in the house was glad about it all.", "en", "a"),
    (2, "The cat sat on the mat. It was a very warm day there. Everybody in the house was glad about it all.", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "", ""), (None, "no id here", "en", "b"), (None, None, None, None),
    (6, "123 456 !!", "en", None), (7, LONG, "en", "b"), (8, "naïve 漢字 ½ \x1c ퟿ 😀", None, "c"), (9, "one", "en", "c"),
]


@pytest.fixture(params=["rows", "empty"])
def docs(make, request):
    return make(ROWS if request.param == "rows" else [])


def n(docs):
    return docs.count()


def test_packing(docs):
    got = packing.best_fit_pack(docs, vocabulary(), capacity=64).toPandas()
    assert got.groupby(["sequence_id"]).length.sum().max() <= 64 if len(got) else n(docs) == 0
    assert (got.piece == 0).sum() == n(docs)
    assert (got.ids.str.len() == 4 * got.length).all()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    assert packing.assemble(packing.best_fit_pack(docs, vocabulary(), capacity=64)).count() == got.sequence_id.nunique()


def test_token_files(spark, docs):
    path = work_path(spark, "edge")
    token_files.write_token_files(docs, path, vocabulary(), shard_tokens=1000)
    got = token_files.read_token_files(spark, path).toPandas().sort_values("start")
    assert len(got) == n(docs)
    assert (got.start.to_numpy() == np.cumsum(got.n_tokens) - got.n_tokens).all()
    assert got.doc_id.isna().sum() == docs.filter("doc_id is null").count()
    known = got.doc_id.dropna()
    assert known.is_monotonic_increasing
    assert (got.ids.str.len() == 4 * got.n_tokens).all()


def test_substrings(docs):
    got = substring.remove_repeats(docs).select("row.doc_id", "text", "n_removed").toPandas()
    assert len(got) == n(docs)
    if len(got):
        assert got[got.doc_id == 1].n_removed.iloc[0] == 0
        assert (got[got.doc_id == 2].text == "").all() and len(got[got.doc_id == 2]) == 2
        assert got[got.doc_id == 3].text.isna().all()
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id in (2, 3, 4, 5)").count() == 0


def test_similar(docs):
    got = jaccard.similar_documents(docs).toPandas()
    assert len(got) == n(docs)
    if len(got):
        by = got.set_index("doc_id")
        assert set(by.loc[[1, 2]].component_id) == {1}
        assert by.n_shingles[9] == 1 and by.n_shingles[3] == 0 and by.component_id[4] == 4
        assert got[got.doc_id.isna()].component_id.isna().all()
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns
    assert one.filter("doc_id = 2").count() == 0 and one.filter("doc_id is null").count() == docs.filter("doc_id is null").count()


def test_suffixes(docs):
    got = suffix.repeated_strings(docs).toPandas()
    assert len(got) == n(docs)
    if len(got):
        by = got.set_index("doc_id")
        assert by.n_removed[1] == 0 and (by.n_removed[2] == by.n_bytes[2]).all()  # rows of one id keep what only they share, here nothing
        assert by.n_bytes[3] == 0 and by.n_removed[9] == 0 and by.n_removed[7] == 0


def test_mixing(docs):
    got = mixing.mix_plan(docs).toPandas()
    assert len(got) == n(docs) and (got.taken <= 3 * got["size"]).all()
    if len(got):
        assert got[got.doc_id == 7].taken.iloc[0] > 0 and got.drop_duplicates("source").target.sum() == pytest.approx(got["size"].sum()) and got.source.isna().sum() == 3
        assert got[got["size"] == 0].taken.sum() == 0
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns


def test_language(docs):
    model = language.train(docs, F.lit(True))
    got = language.predict(docs, model).toPandas()
    assert len(got) == n(docs)
    if len(got):
        by = got.set_index("doc_id")
        assert set(by.lang_pred[[3, 4, 5, 6]]) == {"und"} and by.lang_pred[7] in ("en", "")
    assert got.score.between(0, 1).all()
    assert language.keep_identified(docs, model).columns == docs.columns
    assert (language.predict(docs, language.fit(np.empty((0, language.BUCKETS)), [])).toPandas().lang_pred == "und").all()


def test_quality(docs):
    got = quality.quality_rules(docs).toPandas()
    assert len(got) == n(docs)
    if len(got):
        by = got.set_index("doc_id")
        assert by.n_words[3] == 0 and by.base_failed[3] and not by.kept[9] and by.word_chars[9] == 3


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("doc_id = 7")):
        got = toxicity.score(docs, toxicity.train(docs, known, "true")).toPandas()
        assert len(got) == n(docs) and got.score.between(0, 1).all()


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, norm string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (50, [0.5, 0.5], "x"), (50, [0.5, 0.5], "x"), (3, None, ""), (4, [nan, 1.0], ""), (5, [inf, 1.0], ""), (6, [None, 1.0], ""), (None, [1.0, 1.0], ""), (7, [0.0, 0.0], ""), (8, [1.0, 0.0], ""), (9, [1.0, 0.0], ""), (100, [1.0], ""), (150, [], "")]
    got = topk.top_products(spark.createDataFrame(rows, schema), k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 8, 65536), (0, 2, 9, 65536), (50, 1, 0, 32768), (50, 2, 8, 32768)]
    assert topk.top_products(spark.createDataFrame([], schema)).count() == 0
