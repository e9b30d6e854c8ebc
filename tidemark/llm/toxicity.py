"""Toxicity by compression distance: two zstandard dictionaries, and the lengths windows of a text compress to.

One dictionary holds ordinary text; the other holds the same and, behind it, words that set toxic training texts
apart. A window that the second compresses better holds such a word. How much better, and how often, is turned into a
score by a logistic curve calibrated on training rows that the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, text_batches, worker_state

#: Words in a window.
WINDOW_WORDS = 4
#: Put before every window and into both dictionaries: the fixed cost of a match is then paid on both sides.
LEAD = b" one two three four five six seven "
LEVEL = 3
#: Longer words also count by their first so many letters.
STEM = 5
#: Windows that gain at least so many bytes are counted.
STEPS = (2, 3, 4, 5, 6)
_WINDOWS = re.compile(r"\S+(?:\s+\S+){0,%d}" % (WINDOW_WORDS - 1))


def windows(text: str | None) -> list[bytes]:
    return [(" " + " ".join(w.split()) + " ").encode() for w in _WINDOWS.findall((text or "").lower())]


@dataclass(frozen=True)
class ToxicModel:
    """Dictionary contents and the logistic curve; without both classes to learn from, ``base`` for every text."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    base: float = 0.0

    def compressors(self):
        import zstandard

        key = ("toxic", hash((self.ordinary, self.toxic)))
        held = worker_state("toxicity")
        if key not in held:
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL)
            pair = []
            for content in (LEAD + self.ordinary, LEAD + self.ordinary + self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                pair.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)
            held[key] = tuple(pair)
        return held[key]

    def features(self, text: str | None) -> np.ndarray:
        plain, with_toxic = self.compressors()
        gain = np.array([len(plain(LEAD + w)) - len(with_toxic(LEAD + w)) for w in windows(text)] or [0])
        return np.array([min(gain.max(), 16), *[np.log1p((gain >= k).sum()) for k in STEPS], np.log1p(len(gain)), 1.0])

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ np.array(self.weights), -30, 30))))


def telling_words(toxic: Sequence[str], ordinary: Sequence[str], least: int = 10, ratio: float = 15.0) -> list[str]:
    """Words and stems of toxic texts, the most telling last: those that follow many different words there, and few elsewhere.

    Counting different words before, not uses, keeps copies of one text from lending weight to its words.
    """

    def spread(texts: Iterable[str]) -> tuple[Counter, int]:
        pairs, n = set(), 0
        for t in set(texts):
            ws = t.lower().split()
            n += len(ws)
            for before, w in zip(["", *ws], ws):
                pairs.add((before, w))
                if len(w) > STEM:
                    pairs.add((before, w[:STEM]))
        return Counter(w for _, w in pairs), max(n, 1)

    (a, na), (b, nb) = spread(toxic), spread(ordinary)
    rate = {w: (c / na) / ((b[w] + 0.5) / nb) for w, c in a.items() if c >= least}
    return sorted((w for w, r in rate.items() if r > ratio), key=lambda w: (rate[w], w))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: Sequence[str | None], labels: Sequence[int], dictionary_bytes: int = 16_384) -> ToxicModel:
    """Dictionaries from two thirds of the rows, calibration from the others."""
    import zstandard

    rows = [(t or "", int(y > 0)) for t, y in zip(texts, labels, strict=True)]
    y = np.array([v for _, v in rows])
    if not len(y) or y.min() == y.max():
        return ToxicModel(b"", b"", (), float(y.mean()) if len(y) else 0.0)
    nth = {1: 0, 0: 0}
    held_out = []
    for _, v in rows:  # every third of each label
        held_out.append(nth[v] % 3 == 0)
        nth[v] += 1
    learn = [r for r, h in zip(rows, held_out, strict=True) if not h]
    toxic, plain = ([t for t, v in learn if v == k] for k in (1, 0))
    samples = [w for t in plain for w in windows(t)][:100_000]
    try:
        ordinary = zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: all of them
        ordinary = b"".join(samples)[:dictionary_bytes]
    found = "".join(f" {w}" for w in telling_words(toxic, plain, least=min(10, max(3, len(toxic) // 40))))
    found = ".".join([found] * 3)  # fast matching indexes every third place of a dictionary: three alignments
    model = ToxicModel(ordinary, found.encode()[-dictionary_bytes:], (0.0,) * (len(STEPS) + 3))
    held = [r for r, h in zip(rows, held_out, strict=True) if h] if len(rows) >= 60 else rows
    x = np.array([model.features(t) for t, _ in held])
    w = _logistic(x, np.array([v for _, v in held], float))
    return ToxicModel(model.ordinary, model.toxic, tuple(map(float, w)))


def train(docs: DataFrame, labels: DataFrame, use: str, max_toxic: int = 1_500, max_ordinary: int = 3_000) -> ToxicModel:
    """Fit on a bounded sample of labelled rows: of each label those with the smallest hash of their id.

    ``labels`` has ``doc_id`` and ``toxic``; a row takes part where the SQL condition ``use`` over ``doc_id`` holds
    and neither id nor label is null; of several labels the highest counts. At most ``max_toxic + max_ordinary`` ids take
    part, and of documents that repeat ids at most twice as many rows, with their whole texts. Null texts count as
    empty. Without labels, or with one class alone, the model gives every text that class's share (0 without labels).
    The ordinary dictionary is trained on the first 100,000 windows of these rows.
    """
    known = labels.filter(use).filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, max_toxic).union(pick(0, max_ordinary)).withColumnRenamed("doc_id", "_id").withColumnRenamed("toxic", "_label")
    named = docs.select(column("doc_id").alias("_id"), column("text").alias("text"))
    found = named.join(F.broadcast(ids), "_id").select("_label", "text", F.xxhash64("_id").alias("_h"))
    rows = found.orderBy("_h", "text").limit(2 * (max_toxic + max_ordinary)).collect()
    return fit([r["text"] for r in rows], [r["_label"] for r in rows])


def score(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``: how likely each whole text is toxic, 0 to 1.

    Null and empty texts get the score of a text without words; repeated rows are scored each; other columns are
    ignored; no documents, no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, schema)
