"""Substring deduplication by sliding spans of sentences.

Every run of several consecutive sentences is hashed, the hashes of all documents are joined, and sentences covered by
a run that occurred before are removed. "Before" is the order of document ids, then of places in the text.

A run starts at each sentence and takes the fewest sentences that make ``span_sentences`` and ``span_words`` words, or
``long_words`` words; and one ends at each sentence, taken backwards by the same rule, so that the last sentences of a
repeated passage are covered whatever follows them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, parallelism, text_batches, worker_state

#: Where a sentence ends: after a full stop, exclamation or question mark before white space, or at a line's end.
_ENDS = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """``start, end, words joined by spaces in lower case, number of words``; an end takes the white space behind along."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        words = text[at : m.start()].lower().split()
        if words:
            out.append((at, m.end(), " ".join(words), len(words)))
            at = m.end()
    words = text[at:].lower().split()
    if words:
        out.append((at, len(text), " ".join(words), len(words)))
    return out


def runs(counts: list[int], span_sentences: int, span_words: int, long_words: int) -> list[tuple[int, int]]:
    """Runs ``(first, last)`` of sentences, forwards from each and backwards from each."""
    total = np.concatenate(([0], np.cumsum(counts, dtype="i8")))
    n = len(counts)
    if not n:
        return []
    at = np.arange(n)
    # forwards: the smallest end (exclusive) that satisfies either condition
    both = np.maximum(np.searchsorted(total, total[:-1] + span_words), at + span_sentences)
    end = np.minimum(both, np.searchsorted(total, total[:-1] + long_words))
    found = {(int(i), int(e) - 1) for i, e in zip(at, end, strict=True) if e <= n}
    # backwards: the largest start
    both = np.minimum(np.searchsorted(total, total[1:] - span_words, "right") - 1, at + 1 - span_sentences)
    start = np.maximum(both, np.searchsorted(total, total[1:] - long_words, "right") - 1)
    found |= {(int(s), int(j)) for s, j in zip(start, at, strict=True) if s >= 0}
    return sorted(found)


def repeated_spans(docs: DataFrame, span_sentences: int = 3, span_words: int = 20, long_words: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, start, end``: character spans of runs that occurred before. ``key`` is a hash of the text."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("key", "start", "end")], T.StructField("hash", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring")
        for b in text_batches(batches, 1_000_000):
            row, start, end, hashes = [], [], [], []
            for at, text_ in enumerate(b.column(1).to_pylist()):
                found = sentences(text_ or "")
                for i, j in runs([s[3] for s in found], span_sentences, span_words, long_words):
                    row.append(at)
                    start.append(found[i][0])
                    end.append(found[j][1])
                    hashes.append(xxhash.xxh3_128_digest(" ".join([s[2] for s in found[i : j + 1]])))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(hashes, pa.binary())], names=schema.names)

    d = docs.filter(column(text).isNotNull()).select(column(doc_id).alias("doc_id"), column(text).alias("text"), F.xxhash64(column(text)).alias("key"))
    spans = d.mapInArrow(run, schema)
    place = F.struct("doc_id", "key", "start", "end")
    seen = spans.groupBy("hash").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).filter("_n > 1").select("hash", "_first")
    seen = seen.repartition(parallelism(docs.sparkSession))  # off the hash, so that the join deals both sides anew and splits hot hashes
    return spans.join(seen, "hash").filter(~place.eqNullSafe(F.col("_first"))).select("doc_id", "key", "start", "end")


def remove_repeats(docs: DataFrame, span_sentences: int = 3, span_words: int = 20, long_words: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, text, n_removed, n_spans``: the other columns as a struct, what is left of the text, and how many characters
    and maximal spans are gone; ``without_repeats`` gives the documents.

    Null and empty texts stay as they are. Rows equal in id and text are one document and lose the same; null ids come
    first in the order. A text whose sentences all occurred before becomes empty. No documents, no rows.
    """
    spans = repeated_spans(docs, span_sentences, span_words, long_words, doc_id, text)
    per_doc = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    row = F.struct(*[column(c) for c in docs.columns if c != text]).alias("row")
    d = docs.select(row, column(text).alias("text"), column(doc_id).alias("_id"), F.xxhash64(column(text)).alias("_key"))
    d = d.join(per_doc, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")), "left").select("row", "text", "spans")
    out = T.StructType([d.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, many = b.column(1).to_pylist(), [0] * b.num_rows, [0] * b.num_rows
            for i, spans_ in enumerate(b.column(2).to_pylist()):
                if not spans_:
                    continue
                merged = []
                for s in spans_:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                edges = [0, *[x for m in merged for x in m], len(kept[i])]
                removed[i], many[i] = sum(e - s for s, e in merged), len(merged)
                kept[i] = "".join(kept[i][s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(many, pa.int64())], names=out.names)

    return d.mapInArrow(cut, out)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rule: int) -> DataFrame:
    """The documents, with all columns, without repeated spans; those of which nothing is left, or which had no text, go."""
    d = remove_repeats(docs, doc_id=doc_id, text=text, **rule).filter(r"text RLIKE '\\S'")
    return d.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
