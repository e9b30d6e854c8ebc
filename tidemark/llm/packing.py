"""Best-fit packing of documents into token sequences of a fixed capacity.

Planning works on the histogram of piece lengths, never on documents: lengths in descending order go to the tightest
open sequences, whole groups of equal sequences at a time. The plan says which ranks of a length go to which slots;
pieces find theirs by joining on the rank within their length. Its size depends on the capacity alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import binary_array, checkpoint, column, lookup, text_batches
from tidemark.llm.tokens import encoder

Segment = tuple[int, int, int, int, int, int]


def plan_sequences(counts: Mapping[int, int], capacity: int) -> list[Segment]:
    """Best fit, longest first, over ``{length: count}``.

    Returns ``(length, lo, hi, per, sequence, offset)``: of this length, ranks ``lo <= r < hi`` fill sequences from
    ``sequence`` on, ``per`` of them in each, the first at ``offset``. A sequence takes as many pieces of a length as
    fit before the next tightest one is opened, which is what placing them one by one does.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first sequence, how many)
    out: list[Segment] = []
    made = 0
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            room = next((r for r in range(length, capacity + 1) if open_.get(r)), capacity)
            if not open_[room]:
                need = -(-(total - rank) // (capacity // length))
                open_[room].append((made, need))
                made += need
            first, n = open_[room].pop()
            per = room // length
            full = min(n, (total - rank) // per)
            if full:
                out.append((length, rank, rank + full * per, per, first, capacity - room))
                open_[room - per * length].append((first, full))
                rank += full * per
            rest = total - rank
            if full < n and 0 < rest:
                out.append((length, rank, total, rest, first + full, capacity - room))
                open_[room - rest * length].append((first + full, 1))
                rank, full = total, full + 1
            if full < n:
                open_[room].append((first + full, n - full))
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids, part, rank``.

    A document is the ids of its whole text (null: none), then ``end_id``. One longer than ``capacity`` is cut from
    its end, so that only its first piece may be shorter. ``ids`` are little-endian, 2 bytes each where the vocabulary
    allows, else 4. ``rank`` counts equal lengths within ``part``, the task that cut them.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "part", "rank")], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        end = np.array([end_id], enc.dtype)
        for b in text_batches(batches):
            each = enc.encode(b.column(1).to_pylist())
            sizes = np.array([len(x) + 1 for x in each], "i8")
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (sizes - (pieces - 1) * capacity)[doc]
            length = np.where(number == 0, first, capacity)
            start = np.where(number == 0, 0, first + (number - 1) * capacity)
            rank = seen[length] + pd.Series(length).groupby(length).cumcount().to_numpy()
            seen += np.bincount(length, minlength=capacity + 1)
            ids = np.concatenate([x for y in each for x in (y, end)])
            cols = [b.column(0).take(pa.array(doc)), number, start, length, np.full(len(doc), part), rank]
            yield pa.RecordBatch.from_arrays([cols[0], *[pa.array(c, pa.int64()) for c in cols[1:]], binary_array(ids, np.cumsum(length))], names=schema.names)

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, schema)


def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ids`` (last column) as 4 bytes each, whatever width they had."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, length = b.column(b.num_columns - 1), b.column("length").to_numpy()
        data = np.frombuffer(b"".join(ids.to_pylist()), "<u2" if len(ids[0].as_py()) == 2 * length[0] else "<u4")
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], binary_array(data.astype("<u4"), np.cumsum(length))], names=b.schema.names)


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, sequence_id, offset, ids`` (4 bytes each, little-endian), a row per piece;
    ``assemble`` makes sequences of them. Null and empty texts are a document of ``end_id`` alone; repeated rows and
    repeated or null ids are documents of their own; other columns are ignored; no documents, no rows.

    Work: documents are encoded once and the pieces kept in the checkpoint folder. Ranks within a length are the rank
    within the task plus the counts of the tasks before, so no task sees all pieces of a hot length.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut_pieces(docs, tokenizer, capacity, end_id, doc_id, text))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = checkpoint(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n")))
    base = counts.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_sequences(histogram, capacity), "_l long, _lo long, _hi long, _per long, _seq long, _off long")
    at = F.col("rank") + F.col("_before")
    slot = (F.col("length") == F.col("_l")) & (at >= F.col("_lo")) & (at < F.col("_hi"))
    out = lookup(pieces, base, ["part", "length"]).join(F.broadcast(plan), slot)
    nth = at - F.col("_lo")
    out = out.select(
        "doc_id", "piece", "start", "length",
        (F.col("_seq") + F.expr("(rank + _before - _lo) div _per")).alias("sequence_id"),
        (F.col("_off") + (nth % F.col("_per")) * F.col("length")).alias("offset"), "ids",
    )
    return out.mapInArrow(widen, out.schema)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the pieces of each sequence joined in their order; a sequence is at most ``capacity`` long."""
    g = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return g.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), joined.alias("ids"))
