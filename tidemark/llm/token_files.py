"""Token ids in binary files of patched frame-of-reference blocks.

A file is one shard of consecutive documents in ascending order of their ids:

    64 bytes        ASCII header: ``TMPFOR1 part ordinal documents tokens block_length blocks``, padded with spaces
    8 per document  ids (signed), then 1 byte per document: 1 where the id is null
    4 per document  numbers of tokens
    8 per block     index: where each block starts, from the beginning of the file
    blocks          minimum (4), width in bits (1), number of exceptions (2), ``block_length * width`` bits of
                    value - minimum, positions of exceptions (2 each), their whole value - minimum (4 each)
    5 bytes         end mark

All numbers are little-endian. The width is the one that holds a percentile of the block's differences; what needs
more bits is an exception. The last block of a file is filled up with its last value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary_array, column, lookup, parallelism, text_batches
from tidemark.llm.tokens import encoder

HEAD, END = 64, "TMEND"
DOCS_SCHEMA = "part long, ordinal long, doc_id long, at long, n_tokens long, ids binary"


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Blocks of ``width``-bit numbers, packed; a row of bytes for each. ``rows`` has a multiple of 64 columns."""
    cols, n = rows.T.astype("u8", order="C"), rows.shape[1]
    out = np.zeros((n * width // 64 + 1, len(rows)), "u8")
    for j in range(n):
        word, shift = divmod(j * width, 64)
        out[word] |= cols[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= cols[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:-1].T).view("u1")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    out, mask = np.empty((n, len(packed)), "u8"), np.uint64((1 << width) - 1)
    for j in range(n):
        word, shift = divmod(j * width, 64)
        out[j] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= words[word + 1] << np.uint64(64 - shift)
        out[j] &= mask
    return out.T


def pack_blocks(ids: np.ndarray, block: int = 128, percentile: float = 90.0) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, where each block starts)`` of unsigned 32-bit ids."""
    n = -(-len(ids) // block)
    if not n:
        return np.empty(0, "u1"), np.empty(0, "i8")
    full = np.concatenate((ids, np.repeat(ids[-1:], n * block - len(ids)))).astype("<u4").reshape(n, block)
    low = full.min(axis=1)
    diff = full - low[:, None]
    nth = min(block - 1, int(block * percentile / 100))
    width = np.ceil(np.log2(np.partition(diff, nth, axis=1)[:, nth].astype("f8") + 1)).astype("i8")
    odd = (diff.astype("u8") >> width[:, None].astype("u8")) > 0
    odds = odd.sum(axis=1)
    size = 7 + block * width // 8 + 6 * odds
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), "u1")
    head = np.empty((n, 7), "u1")
    head[:, :4], head[:, 4], head[:, 5:] = low.astype("<u4").view("u1").reshape(n, 4), width, odds.astype("<u2").view("u1").reshape(n, 2)
    out[start[:, None] + np.arange(7)] = head
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        kept = diff[at].astype("u8") & np.uint64((1 << int(w)) - 1)
        out[(start[at] + 7)[:, None] + np.arange(block * w // 8)] = _pack(kept, int(w))
    row, col = np.nonzero(odd)
    nth_odd = np.arange(len(row)) - (np.cumsum(odds) - odds)[row]
    lists = (start + 7 + block * width // 8)[row]
    out[(lists + 2 * nth_odd)[:, None] + np.arange(2)] = col.astype("<u2").view("u1").reshape(-1, 2)
    out[(lists + 2 * odds[row] + 4 * nth_odd)[:, None] + np.arange(4)] = diff[row, col].astype("<u4").view("u1").reshape(-1, 4)
    return out, start


def unpack_blocks(data: np.ndarray, start: np.ndarray, block: int = 128) -> np.ndarray:
    """The ids of the blocks that begin at ``start``; any choice of blocks can be read."""
    n = len(start)
    if not n:
        return np.empty(0, "<u4")
    head = data[start[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, odds = head[:, 4].astype("i8"), np.ascontiguousarray(head[:, 5:]).view("<u2")[:, 0].astype("i8")
    diff = np.zeros((n, block), "u8")
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        diff[at] = _unpack(data[(start[at] + 7)[:, None] + np.arange(block * w // 8)], int(w), block)
    row = np.repeat(np.arange(n), odds)
    nth_odd = np.arange(len(row)) - (np.cumsum(odds) - odds)[row]
    lists = (start + 7 + block * width // 8)[row]
    col = np.ascontiguousarray(data[(lists + 2 * nth_odd)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
    diff[row, col] = np.ascontiguousarray(data[(lists + 2 * odds[row] + 4 * nth_odd)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (diff + low[:, None]).astype("<u4").reshape(-1)


def shard_bytes(part: int, ordinal: int, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray, block: int, percentile: float) -> bytes:
    data, start = pack_blocks(ids, block, percentile)
    fixed = HEAD + 13 * len(sizes) + 8 * len(start)
    head = f"TMPFOR1 {part} {ordinal} {len(sizes)} {len(ids)} {block} {len(start)}".ljust(HEAD).encode()
    null = doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1")
    return b"".join((head, doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), (start + fixed).astype("<i8").tobytes(), data.tobytes()))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = 2_000_000, block: int = 128, percentile: float = 90.0) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending order of ``doc_id`` (a whole number).

    Null and empty texts are ``end_id`` alone; null ids come first; rows that repeat an id follow one another, by text;
    other columns are ignored. Ranges of ids go to tasks, each task streams its range into files of about
    ``shard_tokens`` tokens, at most one document more; Spark commits the files, so a task that runs twice leaves one copy.
    """
    if block % 64 or not 64 <= block <= 1 << 15:
        raise ValueError("block must be a multiple of 64, at most 32768")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ordinal = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        held, held_ids, n = [], [], 0

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], "i8")
            image = shard_bytes(part, ordinal, pa.concat_arrays(held_ids), sizes, np.concatenate(held), block, percentile)
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["value"])

        for b in text_batches(batches, 2_000_000):
            each = [np.concatenate((x, end)) for x in enc.encode(b.column(1).to_pylist())]
            held += each
            held_ids.append(b.column(0))
            n += sum(map(len, each))
            if n >= shard_tokens:
                yield shard()
                held, held_ids, n, ordinal = [], [], 0, ordinal + 1
        if held:
            yield shard()

    d = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    d = d.repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = d.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    shards.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: ``doc_id, start, n_tokens, ids`` (4 bytes each, little-endian).

    ``start`` counts the tokens of all documents before: those of the shards before, from their headers, and those
    before it in its shard.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    word = F.split(F.substring("content", 1, HEAD).cast("string"), " ")
    heads = files.select(*[word[i + 1].cast("long").alias(n) for i, n in enumerate(("part", "ordinal", "docs", "tokens"))])
    parts = heads.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    prior = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(prior), F.lit(0)).alias("_part"))
    own = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    base = heads.join(parts, "part").select("part", "ordinal", (F.col("_part") + F.coalesce(F.sum("tokens").over(own), F.lit(0))).alias("_base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = np.frombuffer(content.as_buffer(), "u1")
                part, ordinal, docs, tokens, block, blocks = map(int, bytes(data[8:HEAD]).split())
                at = HEAD
                doc = data[at : at + 8 * docs].view("<i8")
                null = data[at + 8 * docs : at + 9 * docs].astype(bool)
                sizes = np.frombuffer(data[at + 9 * docs : at + 13 * docs].tobytes(), "<u4").astype("i8")
                start = np.frombuffer(data[at + 13 * docs : at + 13 * docs + 8 * blocks].tobytes(), "<i8")
                ids = unpack_blocks(data, start, block)[:tokens]
                ends = np.cumsum(sizes)
                cols = [np.full(docs, part), np.full(docs, ordinal), pa.array(doc, mask=null), ends - sizes, sizes]
                yield pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], binary_array(ids, ends)], names=["part", "ordinal", "doc_id", "at", "n_tokens", "ids"])

    out = lookup(files.mapInArrow(run, DOCS_SCHEMA), base, ["part", "ordinal"])
    return out.select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids")
