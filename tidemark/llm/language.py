"""Language identification in two steps: the family of languages, then the language within it.

Texts are histograms of hashed byte trigrams. Families are groups of languages with like histograms, found from the
training rows. Families, and the languages of each, are told apart by linear support vector machines, one for each
pair. Scores are sums of weights over a text's trigrams, so that a whole text costs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import binary_array, column, text_batches, worker_state

#: Buckets of the trigram hash.
BUCKETS = 4096
UNDETERMINED = "und"


def trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of lower-cased texts, one after the other, and where each text's begin; at least one each."""
    raw = [b" " + (t or "").lower().encode() + b"  " for t in texts]
    b = np.frombuffer(b"".join(raw), "u1").astype("u4")
    sizes = np.array([len(r) for r in raw])
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.append(h >> np.uint32(20), [0, 0]), np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Machine:
    """``weights @ histogram + bias`` is above zero for ``first``."""

    first: int
    second: int
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    families: tuple[tuple[int, ...], ...]
    between: tuple[Machine, ...]
    within: tuple[tuple[Machine, ...], ...]

    def predict(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text, and a score: the chance of the family times that of the language."""
        grams, start = trigrams(texts)
        length = np.diff(np.append(start, len(grams)))
        family, p = _vote(self.between, len(self.families), grams, start, length)
        out, score = np.zeros(len(texts), "i8"), p.copy()
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if not len(at):
                continue
            if len(members) == 1:
                out[at] = members[0]
                continue
            own, first = np.concatenate([grams[start[i] : start[i] + length[i]] for i in at]), np.cumsum(length[at]) - length[at]
            best, q = _vote(self.within[f], len(members), own, first, length[at])
            out[at], score[at] = np.array(members)[best], p[at] * q
        return out, score


def _vote(machines: Sequence[Machine], n: int, grams: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner of pairwise decisions, ties to the larger sum of margins, and the chance of its closest decision."""
    if n == 1:
        return np.zeros(len(start), "i8"), np.ones(len(start))
    wins, margin, worst = np.zeros((len(start), n)), np.zeros((len(start), n)), np.ones((len(start), n))
    for m in machines:
        v = np.add.reduceat(m.weights[grams], start) / length + m.bias
        p = 1 / (1 + np.exp(-np.clip(3 * v, -30, 30)))
        for k, sign, q in ((m.first, 1, p), (m.second, -1, 1 - p)):
            wins[:, k] += sign * v > 0
            margin[:, k] += np.tanh(sign * v)
            worst[:, k] = np.minimum(worst[:, k], q)
    best = (wins + margin / (2 * n)).argmax(axis=1)
    return best, worst[np.arange(len(start)), best]


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge by accelerated gradient steps, classes weighted alike; columns are standardised first."""
    root = x.dtype.type(np.sqrt(x.shape[1]))
    mean, scale = x.mean(axis=0), (x.std(axis=0) + x.dtype.type(1e-4)) * root
    z = np.ones((len(x), x.shape[1] + 1), x.dtype)
    np.divide(np.subtract(x, mean, out=z[:, :-1]), scale, out=z[:, :-1])
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    v = np.ones(z.shape[1], z.dtype)
    for _ in range(12):
        v = z.T @ (c * (z @ v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (2 * np.linalg.norm(z.T @ (c * (z @ v))) + penalty)
    w = u = np.zeros(z.shape[1], z.dtype)
    for t in range(steps):
        loss = np.maximum(0, 1 - y * (z @ u))
        new = u - rate * (penalty * u - 2 * (z.T @ (c * y * loss)))
        u, w = new + t / (t + 3) * (new - w), new
    weights = w[:-1] / scale
    return weights.astype("f4"), float(w[-1] - mean @ weights)


def group_languages(centroids: np.ndarray) -> list[list[int]]:
    """Families: the closest groups of languages are joined until no more than the square root of their number is left."""
    z = centroids - centroids.mean(axis=0)
    z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-12
    like, groups = z @ z.T, [[i] for i in range(len(z))]
    while len(groups) > np.ceil(np.sqrt(len(z))):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: like[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return groups


def fit(histograms: np.ndarray, labels: Sequence[str]) -> LanguageModel:
    """Families and machines from histograms (rows that sum to one) and their languages."""
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(v) for v in labels], "i8")
    x = histograms.astype("f4", copy=False)
    if not languages:
        return LanguageModel((), (), (), ())
    families = group_languages(np.array([x[y == k].mean(axis=0) for k in range(len(languages))])) if len(languages) > 1 else [[0]]

    def pairs(groups: list[list[int]]) -> tuple[Machine, ...]:
        out = []
        for a, b in combinations(range(len(groups)), 2):
            one, two = np.isin(y, groups[a]), np.isin(y, groups[b])
            out.append(Machine(a, b, *_svm(x[one | two], np.where(one, 1, -1)[one | two].astype("f4"))))
        return tuple(out)

    return LanguageModel(languages, tuple(map(tuple, families)), pairs(families), tuple(pairs([[k] for k in f]) for f in families))


def train(docs: DataFrame, use: Column, max_rows: int = 2_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample: at most ``max_rows`` whole texts, as many of each language, by the hash of their id.

    Rows where ``use`` does not hold, or text or language is null, take no part.
    """
    d = docs.filter(use & column(lang).isNotNull() & column(text).isNotNull()).select(column(lang).alias("lang"), column(text).alias("text"), F.xxhash64(column(doc_id)).alias("h"))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    if not counts:
        return fit(np.empty((0, BUCKETS)), [])
    each = max(1, max_rows // len(counts))
    share = docs.sparkSession.createDataFrame([(k, 2.0 * each / n) for k, n in counts.items()], "lang string, share double")  # at most max_rows rows
    drawn = d.join(F.broadcast(share), "lang").filter((F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000) | (F.col("share") > 0.02 * each))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.length("text"), "text"))
    drawn = drawn.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "text")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1_000_000):
            grams, start = trigrams(b.column(1).to_pylist())
            ends = np.append(start[1:], len(grams))
            rows = [np.bincount(grams[i:j], minlength=BUCKETS) / (j - i) for i, j in zip(start, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array(np.concatenate(rows).astype("<f4"), BUCKETS * np.arange(1, len(rows) + 1))], names=["lang", "x"])

    rows = drawn.mapInArrow(histogram, "lang string, x binary").collect()  # at most max_rows, 16 kB each
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return fit(np.array([np.frombuffer(r["x"], "<f4") for r in rows]), [r["lang"] for r in rows])


def _guess(model: LanguageModel, texts: pa.Array, lettered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language names and scores; ``und`` and 0 for texts without a letter, or all where nothing was learned."""
    worker_state("language")
    names = np.array([*model.languages, UNDETERMINED], object)
    ok = lettered.to_numpy(zero_copy_only=False).astype(bool)
    lang, score = np.full(len(ok), len(names) - 1), np.zeros(len(ok))
    if len(names) > 1 and ok.any():
        lang[ok], score[ok] = model.predict(texts.filter(lettered).to_pylist())
    return names[lang], score


def _lettered(text: str) -> Column:
    return F.coalesce(column(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0, as all are where nothing was learned. Repeated rows
    are predicted each; other columns are ignored; no documents, no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1_000_000):
            lang, score = _guess(model, b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"), _lettered(text).alias("ok")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.25, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose language is known with a score of at least ``least``.

    Texts that are null or have no letter go; where nothing was learned, all go. A winner of all its pairwise decisions
    scores at least 0.25, so texts unlike any learned language mostly stay at the default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1_000_000):
            lang, score = _guess(model, b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["row"]).filter(pa.array((lang != UNDETERMINED) & (score >= least)))

    d = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(text).alias("text"), _lettered(text).alias("ok"))
    return d.mapInArrow(run, T.StructType([d.schema["row"]])).select("row.*")
