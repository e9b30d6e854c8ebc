"""Exact search for the largest inner products, by norm buckets.

Vectors are sorted by length and cut into buckets of like lengths. A query's best products in the bucket of the longest
vectors give it a threshold. In every other bucket the threshold becomes a cosine: over one, the bucket is left out;
high, vectors are chosen by the ranges their largest coordinates must lie in; else by length alone. Chosen vectors'
products are then computed in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, column
from tidemark.llm.totals import running_totals

#: From this local cosine on, coordinates prune better than lengths.
COORDINATES_FROM = 0.7
#: Coordinates looked at.
FOCUS = 4
FOUND = "query_id long, vec_id long, score long"


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where no sum can pass 2**53."""
    if q.size and p.size and float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2**53:
        return np.rint(q.astype("f8") @ p.T.astype("f8")).astype("i8")
    return q @ p.T


def search_bucket(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query ``(its row, ids, scores)`` of its ``k`` best vectors of a bucket that reach ``least``; ties to smaller ids."""
    order = np.lexsort((p_ids, -np.einsum("ij,ij->i", p.astype("f8"), p.astype("f8"))))
    p, p_ids = p[order], p_ids[order]
    p_len, q_len = np.linalg.norm(p.astype("f8"), axis=1), np.linalg.norm(q.astype("f8"), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(least > 0, least / (q_len * p_len[0]), -1.0) * (1 - 1e-9)  # a hair low, for rounding
        unit_q, unit_p = np.nan_to_num(q / q_len[:, None]), np.nan_to_num(p / p_len[:, None])
    out = []

    def keep(row: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= least[row]) & (p_ids[at] != q_ids[row])
        at, scores = at[ok], scores[ok]
        if len(at) > k:
            ok = scores >= np.partition(scores, -k)[-k]
            at, scores = at[ok], scores[ok]
        best = np.lexsort((p_ids[at], -scores))[:k]
        if len(best):
            out.append((row, p_ids[at[best]], scores[best]))

    by_coordinate = np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1))
    for row in by_coordinate:
        focus = np.argsort(-np.abs(unit_q[row]))[:FOCUS]
        t, c = local[row], unit_q[row, focus]
        half = np.sqrt(np.maximum(0, (1 - t * t) * (1 - c * c))) + 1e-9
        # a vector within the angle may lie on the axis itself, where the query is as near to it
        low, high = np.where(c <= -t, -np.inf, t * c - half), np.where(c >= t, np.inf, t * c + half)
        x = unit_p[:, focus]
        at = np.flatnonzero(((x >= low) & (x <= high)).all(axis=1))
        if len(at):
            keep(row, at, products(q[row : row + 1], p[at])[0])
    by_length = np.flatnonzero(local < COORDINATES_FROM)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(least[by_length] > 0, least[by_length] / q_len[by_length], 0.0) * (1 - 1e-9)
        ends = np.searchsorted(-p_len, -shortest, "right")  # vectors long enough come first
        scores = products(q[by_length], p[: ends.max()])
        for row, own, end in zip(by_length, scores, ends, strict=True):
            keep(row, np.arange(end), own[:end])
    return out


def reached(asked: DataFrame, lengths: DataFrame) -> DataFrame:
    """``dim, block, first, upto``: the last bucket that may hold a product for a block's queries.

    ``asked`` has a ``reach`` per query, the shortest vector that can still meet its threshold; ``lengths`` has the
    longest vector per bucket, which falls from bucket to bucket. Neither carries vectors.
    """
    least = asked.groupBy("dim", "block").agg(F.min("reach").alias("reach"))
    d = least.join(lengths, "dim").filter(F.col("longest") >= F.col("reach") * (1 - 1e-9))  # a hair low, for rounding
    return d.groupBy("dim", "block").agg(F.max("bucket").alias("upto"), F.min("first").alias("first"))


def top_products(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, bucket: int = 2048, block: int = 512, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other vectors, ties to the smaller id.

    Components are ``floor(scale * x)``. Queries are the rows where the SQL condition ``queries`` over ``vec_id`` holds.
    Vectors, and ids, that are null or vectors with null or non-finite components take no part; of rows that repeat an
    id the smallest vector counts; vectors of different dimension do not meet; other columns are ignored. With no
    vectors, or no others, there are no rows.

    Queries go to the buckets in blocks of ``block``: a task holds a bucket of ``bucket`` vectors and a block of queries.
    Once thresholds are known, blocks are of queries that reach about as far, and a block goes only to the buckets
    whose longest vector some query of it can still use.
    """
    v = column(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    d = vectors.filter(column(vec_id).isNotNull() & v.isNotNull()).filter(sound)
    d = d.select(column(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    d = d.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    d = d.select("vec_id", "v", F.size("v").cast("long").alias("dim"), norm.alias("norm"), F.lit(1).cast("long").alias("one"))
    d = running_totals(d, [F.col("dim"), F.col("norm").desc(), F.col("vec_id")], ["one"])
    at = F.col("run_one") - 1
    d = checkpoint(d.select("vec_id", "v", "dim", "norm", F.floor(at / bucket).alias("bucket")))
    packed = lambda x: F.struct(F.transform(x, lambda r: r["vec_id"]).alias("ids"), F.flatten(F.transform(x, lambda r: r["v"])).alias("v"))
    buckets = d.groupBy("dim", "bucket").agg(packed(F.array_sort(F.collect_list(F.struct("vec_id", "v")))).alias("p"))  # at most `bucket` rows each
    lengths = d.groupBy("dim", "bucket").agg(F.sqrt(F.max("norm")).alias("longest"))
    firsts = lengths.groupBy("dim").agg(F.min("bucket").alias("first"))
    one = F.lit(1).cast("long").alias("one")
    asked = d.filter(queries).select("vec_id", "v", "dim", F.sqrt("norm").alias("length"), one)

    def in_blocks(q: DataFrame, *order: Column) -> DataFrame:
        return running_totals(q, [F.col("dim"), *order, F.col("vec_id")], ["one"]).withColumn("block", F.floor((F.col("run_one") - 1) / block))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["dim"]
                p_ids, q_ids = np.array(r["p"]["ids"], "i8"), np.array(r["q"]["ids"], "i8")
                p, q = np.array(r["p"]["v"], "i8").reshape(len(p_ids), n), np.array(r["q"]["v"], "i8").reshape(len(q_ids), n)
                least = np.array([np.iinfo("i8").min if t is None else t for t in r["least"]], "i8")
                found = search_bucket(q_ids, q, least, p_ids, p, k)
                cols = [np.repeat(q_ids[[f[0] for f in found]], [len(f[1]) for f in found]), *(np.concatenate([f[i] for f in found]) for i in (1, 2))] if found else [np.empty(0, "i8")] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def blocks(q: DataFrame) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("vec_id", "v", "least")))
        return q.groupBy("dim", "block").agg(rows.alias("r")).select("dim", "block", packed(F.col("r")).alias("q"), F.transform("r", lambda x: x["least"]).alias("least"))

    def meet(where: DataFrame) -> DataFrame:
        """Products of blocks of queries with the bucket beside each."""
        return where.join(buckets, ["dim", "bucket"]).select("dim", "p", "q", "least").mapInArrow(find, FOUND)

    none = F.lit(None).cast("long").alias("least")
    seeds = blocks(in_blocks(asked, F.col("length").desc()).select("*", none)).join(firsts.withColumnRenamed("first", "bucket"), "dim")
    first = checkpoint(meet(seeds))
    bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    known = asked.join(bound.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
    reach = F.when(F.col("least") > 0, F.col("least") / F.col("length")).otherwise(0.0)
    known = checkpoint(in_blocks(known.withColumn("reach", reach), F.col("reach").desc()))
    ends = reached(known, lengths.join(firsts, "dim")).filter("upto > first")
    rest = blocks(known).join(ends, ["dim", "block"]).withColumn("bucket", F.explode(F.sequence(F.col("first") + 1, F.col("upto"))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # limited to k where rows are made, too
    return first.union(meet(rest)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
