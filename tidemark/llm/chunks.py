"""Texts in chunks, and an exchange of keys between chunks, as arrays.

A pass over all texts yields tens of millions of keys per gigabyte. As rows they would cost more than the texts; here
a chunk sends each of a number of buckets one sorted array of its distinct keys, a bucket answers every chunk with one
array of the same order, and the next pass over the chunk puts the answers back to its keys. Buckets are cut from the
keys' hash and a chunk sends a key once, so that a key which all documents share weighs no more than one per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, column, text_batches

CHUNK_SCHEMA = "chunk long, n_docs long, n_bytes long, ids binary, nulls binary, sizes binary, data binary"
#: Stands for a null id: before all others.
NULL_ID = np.iinfo("i8").min
#: Bytes of text for each bucket of an exchange.
BUCKET_BYTES = 16_000_000


class Chunk:
    """Texts of some documents, one after the other: ``data[starts[i]:ends[i]]`` are the UTF-8 bytes of document ``i``."""

    def __init__(self, row: dict) -> None:
        self.chunk = row["chunk"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.null = np.frombuffer(row["nulls"], "u1").astype(bool)
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(int(sizes.sum()), 1)) if sizes.sum() else b""
        self.data = np.frombuffer(raw, "u1")

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)


def chunk_table(docs: DataFrame, most: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents (whole-number ids, texts) as compressed chunks of about ``most`` bytes, kept in the checkpoint folder.

    A longer text is a chunk of its own. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for b in text_batches(batches, most):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            sizes = np.array([len(r) for r in raw], "<i8")
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = np.where(null, NULL_ID, b.column(0).fill_null(0).to_numpy(zero_copy_only=False)).astype("<i8")
            values = [(part << 32) + number, len(raw), int(sizes.sum()), ids.tobytes(), null.astype("u1").tobytes(), sizes.tobytes(), pack.compress(b"".join(raw))]
            number += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    d = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    return checkpoint(d.mapInArrow(run, CHUNK_SCHEMA))


def n_buckets(chunks: DataFrame) -> int:
    total = chunks.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    return 1 << max(4, int(np.ceil(np.log2(max(total / BUCKET_BYTES, 1)))))


def _thin(values: np.ndarray, width: int) -> bytes:
    """Whole numbers cut to ``width`` bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), "u1")
    out[:, :width] = np.frombuffer(data, "u1").reshape(-1, width)
    return out.view("<u8")[:, 0]


def _bytes_for(most: int) -> int:
    return max(1, (int(most).bit_length() + 7) // 8)


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end among 64-bit keys in the order of buckets: ``buckets + 1`` places."""
    bits = buckets.bit_length() - 1
    edges = (np.arange(1, buckets, dtype="u8") << np.uint64(64 - bits)) if bits else np.empty(0, "u8")
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def exchange(chunks: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, ...]], answer: Callable[..., list[np.ndarray]], buckets: int, key_bits: int = 64, lead_bits: int = 0) -> DataFrame:
    """``chunk, replies``: for each chunk an answer per key it sent, in the order of its keys.

    ``keys_of(row)`` gives a chunk's distinct sorted keys (unsigned, 64 bits; the top ones choose the bucket) and a
    whole number of at least zero with each. ``answer(keys, values)`` gets those of all chunks for one bucket, in the
    order of chunks, and returns an array of small numbers (0 to 255) for each chunk. Of a key ``key_bits`` travel
    beyond the bucket's.

    With ``lead_bits`` (a multiple of 8), ``keys_of`` gives a third array, the keys' leads: their top bits choose the
    bucket instead, keys are in the order of bucket and key and travel whole, ``lead_bits`` of a lead travel beyond the
    bucket's, and ``answer`` gets these as its third argument.
    """
    bits = buckets.bit_length() - 1
    lead_width, lead_shift, lead_mask = lead_bits // 8, np.uint64(max(64 - bits - lead_bits, 0)), np.uint64((1 << lead_bits) - 1)
    width = (key_bits + 7) // 8
    shift = np.uint64(64 - min(64, bits + 8 * width))
    mask = np.uint64((1 << (8 * width)) - 1) if width < 8 else np.uint64(2**64 - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                keys, values, *leads = keys_of(row)
                at = cut(leads[0] if leads else keys, buckets)
                low = int(values.min()) if len(values) else 0
                w = _bytes_for(int(values.max()) - low) if len(values) else 1
                full = np.flatnonzero(np.diff(at))
                cols = [
                    pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array([low] * len(full), pa.int64()), pa.array([w] * len(full), pa.int32()),
                    pa.array([_thin((keys[at[k] : at[k + 1]] >> shift) & mask, width) for k in full], pa.binary()), pa.array([_thin(values[at[k] : at[k + 1]] - low, w) for k in full], pa.binary()),
                    pa.array([_thin((leads[0][at[k] : at[k + 1]] >> lead_shift) & lead_mask, lead_width) if leads else None for k in full], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk", "low", "width", "keys", "vals", "leads"])

    def reply(f: pa.Table) -> pa.Table:
        f = f.sort_by("chunk")
        chunk, bucket, low_, width_ = (f[c].to_numpy() for c in ("chunk", "bucket", "low", "width"))
        keys = [_wide(k.as_buffer(), width) for k in f["keys"]]
        vals = [_wide(v.as_buffer(), w).astype("i8") + low for v, w, low in zip(f["vals"], width_, low_, strict=True)]
        leads = [[_wide(v.as_buffer(), lead_width) for v in f["leads"]]] if lead_width else []
        pack = zstandard.ZstdCompressor(level=1)
        got = [pack.compress(a.astype("u1").tobytes()) for a in answer(keys, vals, *leads)]
        return pa.table({"chunk": chunk, "bucket": bucket, "reply": pa.array(got, pa.binary())})

    sent = chunks.mapInArrow(send, "bucket int, chunk long, low long, width int, keys binary, vals binary, leads binary")
    replies = sent.groupBy("bucket").applyInArrow(reply, "chunk long, bucket int, reply binary")
    return replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))


def answers(replies: Sequence[dict] | None) -> np.ndarray:
    """The replies of all buckets to one chunk, in the order of its keys."""
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r["reply"]), "u1") for r in replies or ()]
    return np.concatenate(parts) if parts else np.empty(0, "u1")


# ---------------------------------------------------------------------------------------------------------
# Hashes of places in a chunk

_FACTOR = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def byte_codes() -> np.ndarray:
    """A fixed 64-bit number for each byte value."""
    return mixed((np.arange(256, dtype="u8") + np.uint64(1)) * np.uint64(_FACTOR))


def joined(h: np.ndarray, first: int, g: np.ndarray, second: int) -> np.ndarray:
    """Hashes of ``first + second`` bytes from those of ``first`` (at each place) and of ``second`` (at each place)."""
    n = len(g) - first
    if n <= 0:
        return np.empty(0, "u8")
    out = h[:n] * _power(second)
    out += g[first : first + n]
    return out
