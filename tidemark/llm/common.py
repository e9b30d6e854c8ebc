"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint, work_path

__all__ = ["WORD", "binary_array", "checkpoint", "column", "crc_mod", "lookup", "parallelism", "small", "table", "text_batches", "work_path", "worker_state"]

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_mod(doc_id: str, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; NULL for a null id."""
    return F.crc32(column(doc_id).cast("string")) % n


def parallelism(spark: SparkSession) -> int:
    """Width of the session's shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def worker_state(owner: str) -> dict[str, Any]:
    """What an operator keeps in a Python worker across tasks; what another operator kept there is let go."""
    name = "_tidemark_llm_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    held = sys.modules[name].__dict__
    if held.get("owner") != owner:
        held["owner"], held["state"] = owner, {}
    return held["state"]


def lookup(df: DataFrame, side: DataFrame, keys: list[str], rows: int = 200_000) -> DataFrame:
    """Inner join with a narrow side: broadcast while that has at most ``rows`` rows, else a shuffle of both."""
    return df.join(F.broadcast(side) if small(side, rows) else side, keys)


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow binaries cut from one array; ``ends`` counts elements."""
    offsets = np.concatenate(([0], ends)) * data.itemsize
    kind = pa.binary() if offsets[-1] < 1 << 31 else pa.large_binary()
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.astype("<i4" if kind == pa.binary() else "<i8").tobytes()), pa.py_buffer(np.ascontiguousarray(data).view("u1"))])


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts (second column) of one add up to about ``most`` bytes; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield b.slice(at, to - at)
            at = to
