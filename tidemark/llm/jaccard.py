"""Similarity join of documents by the Jaccard coefficient of their word n-grams.

T-occurrence search: two sets of sizes n and m are alike enough when they share at least T shingles. Of a set's
inverted lists, those of its rarest shingles are short and merged; the others are long and only probed, by binary
search, for candidates the merge has found. A set that reaches T with another shares one of its ``n - ceil(t*n) + 1``
rarest shingles with it, whatever the order, so nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import _FACTOR, Chunk, answers, byte_codes, chunk_table, exchange, mixed, n_buckets
from tidemark.llm.common import checkpoint, column, lookup, worker_state
from tidemark.llm.components import components
from tidemark.llm.totals import running_totals

SIZE = 5
#: Shingles that a block of sets holds, and one set more.
BLOCK = 1_000_000
SETS = "doc_id long, n_shingles long, digest binary, shingles binary, short array<long>"
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash factor and of its inverse, by place; kept by the worker."""
    held = worker_state("jaccard")
    if len(held.get("powers", ((),))[0]) < n:
        size = max(n, 1 << 21)
        up = np.cumprod(np.full(size, _FACTOR, "u8"))
        down = np.cumprod(np.full(size, pow(_FACTOR, -1, 1 << 64), "u8"))
        held["powers"] = up, down
    return held["powers"]


def shingle_sets(c: Chunk, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each document of a chunk."""
    n = len(c.data)
    if not n:
        return [np.empty(0, "u8")] * len(c.starts)
    text = _LOWER[c.data]
    solid = ~_BLANK[text]
    edge = np.zeros(n + 1, bool)
    edge[c.starts], edge[c.ends] = True, True
    before = np.concatenate(([False], solid[:-1]))
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _powers(n)
    sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(byte_codes()[text] * up[:n])))
    word = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype("u8"))
    at = np.searchsorted(start, c.starts)
    many = np.searchsorted(start, c.ends) - at

    def chained(columns: Sequence[np.ndarray]) -> np.ndarray:
        h = columns[0].copy()
        for w in columns[1:]:
            h = h * np.uint64(_FACTOR) + w
        return mixed(h + np.uint64(len(columns)))

    k = len(word) - size + 1
    grams = chained([word[i : i + k] for i in range(size)]) if k > 0 else np.empty(0, "u8")
    out = []
    for i, m in zip(at, many, strict=True):
        if m >= size:
            out.append(np.unique(grams[i : i + m - size + 1]))
        else:
            out.append(chained([word[j : j + 1] for j in range(i, i + m)]) if m else np.empty(0, "u8"))
    return out


def count_documents(keys: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """In how many documents each key is, over all chunks: exact to 200, above that on a logarithmic scale."""
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts), minlength=len(distinct))
    total = np.where(total <= 200, total, np.minimum(255, 200 + np.ceil(np.log2(np.maximum(total, 1) / 200))))[back]
    return np.split(total.astype("u1"), np.cumsum([len(k) for k in keys])[:-1])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sets_of(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``SETS`` of every document. Sets that no other can be like have null ``shingles`` and ``short``.

    ``short`` holds those of a set's rarest shingles that others have too. A set without any is alone.
    """
    chunks = chunk_table(docs, doc_id=doc_id, text=text)

    def keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([*shingle_sets(Chunk(row), size), np.empty(0, "u8")]), return_counts=True)

    counted = exchange(chunks, keys, count_documents, n_buckets(chunks), key_bits=32)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                c = Chunk(row)
                sets = shingle_sets(c, size)
                known, common = np.unique(np.concatenate([*sets, np.empty(0, "u8")])), answers(row["replies"])
                cols = [[], [], [], []]
                for s in sets:
                    df = common[np.searchsorted(known, s)] if len(s) else np.empty(0, "u1")
                    rarest = np.lexsort((s, df))[: prefix_length(len(s), percent)]
                    short = s[rarest][df[rarest] > 1]
                    alone = not len(short)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    for col, v in zip(cols, (len(s), digest, None if alone else s.tobytes(), None if alone else short.view("i8")), strict=True):
                        col.append(v)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([c.doc_ids(), *[pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SETS.split(", ")])

    return checkpoint(chunks.join(counted, "chunk", "left").mapInArrow(describe, SETS))


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """T: the smallest intersection of sets of sizes n and m with ``100 * intersection >= percent * union``."""
    return -(-percent * (n + m) // (100 + percent))


def search(sets: Sequence[np.ndarray], short: Sequence[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among sets that join all that are linked, directly or through others given here; pairs joined by then are not probed.

    ``sides``: 0 for all sets to meet one another, else 1 and 2 for the sets of two blocks, which meet across.
    """
    n = np.array([len(s) for s in sets], "i8")
    order = np.argsort(n, kind="stable")
    place = np.empty(len(n), "i8")
    place[order] = np.arange(len(n))
    # inverted lists: sets of each shingle that is some set's rare one
    wanted = np.unique(np.concatenate(short))
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(n)), n[order])
    at = np.searchsorted(wanted, flat)
    at = np.minimum(at, len(wanted) - 1)
    hit = wanted[at] == flat
    at, owner = at[hit], owner[hit]
    by = np.argsort(at, kind="stable")
    lists, begin = owner[by], np.searchsorted(at[by], np.arange(len(wanted) + 1))
    parent = list(range(len(n)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    size, side = n[order], sides[order]
    for i in range(1, len(n)):
        own = sets[order[i]]
        rare = np.searchsorted(wanted, short[order[i]])
        # merge of the short lists: how often each smaller set occurs
        merged = [lists[begin[k] : begin[k + 1]] for k in rare]
        met = np.concatenate(merged)
        met = met[met < i]
        if not len(met):
            continue
        found, count = np.unique(met, return_counts=True)
        t = needed(size[i], size[found], percent)
        long_lists = size[i] - prefix_length(int(size[i]), percent)
        ok = (size[found] * 100 >= percent * size[i]) & (count >= t - long_lists)
        if side[i]:
            ok &= side[found] != side[i]
        rest = np.setdiff1d(own, short[order[i]], assume_unique=True) if ok.any() else own
        for j, c, least in zip(found[ok], count[ok], t[ok], strict=True):
            a, b = root(i), root(int(j))
            if a == b:
                continue
            other = sets[order[j]]
            p = np.minimum(np.searchsorted(other, rest), len(other) - 1)
            if c + np.count_nonzero(other[p] == rest) >= least:
                parent[a] = b
                links.append((int(order[i]), int(order[j])))
    return links


def similar_documents(docs: DataFrame, percent: int = 80, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, copies`` of every row.

    Words are runs of characters other than white space (space, 9 to 13), A-Z in lower case; a document's set holds its
    distinct shingles of ``size`` words, or its whole sequence if it has fewer words. Two documents are linked when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id that links reach. ``copies`` counts
    the rows with the same set.

    Null and empty texts have no shingles and no links. Rows that repeat an id are one document for links. Null ids
    have null as their component and link nothing. Other columns are ignored; no documents, no rows. Shingles are
    compared by 64-bit hashes.

    Work: equal sets are one class. Classes that share a rare shingle, directly or through others, form a family.
    Families are cut into blocks of ``BLOCK`` shingles in the order of set sizes; a task searches one block, or two
    blocks of one family with sizes within reach. A task's links only join what it has not joined yet, so a group of
    near copies leaves no more links than it has members, and never lies in one task as a whole.
    """
    sets = sets_of(docs, size, percent, doc_id, text)
    classes = checkpoint(sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    ours = classes.select("digest", F.col("rep").alias("doc_id"))
    reps = sets.filter("short IS NOT NULL AND doc_id IS NOT NULL").select("digest", "doc_id", "n_shingles", "short").join(ours, ["digest", "doc_id"]).dropDuplicates(["digest"])
    reps = checkpoint(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "digest", "short"))
    lists = reps.select("rep", F.explode("short").alias("shingle"))
    first = lists.groupBy("shingle").agg(F.min("rep").alias("a"), F.max("rep").alias("_last")).filter("a <> _last").drop("_last")
    stars = lists.join(first, "shingle").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    family = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    r = running_totals(reps.drop("short").join(family, "rep"), [F.col("family"), F.col("n"), F.col("rep"), F.col("digest")], ["n"])
    r = checkpoint(r.withColumn("block", F.floor((F.col("run_n") - F.col("n")) / BLOCK)))
    spans = r.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = spans.select("family", F.col("block").alias("second"), F.col("least").alias("least2"))
    across = spans.join(other, "family").filter((F.col("second") > F.col("block")) & (100 * F.col("most") >= percent * F.col("least2")))
    both = F.array(F.struct("block", F.lit(1).alias("side")), F.struct(F.col("second").alias("block"), F.lit(2).alias("side")))
    sides = across.select("family", F.col("block").alias("first"), "second", F.explode(both).alias("x")).select("family", "first", "second", "x.*")
    inside = r.select(F.col("block").alias("first"), F.col("block").alias("second"), F.lit(0).alias("side"), "rep", "digest")
    crossing = r.join(sides, ["family", "block"]).select("first", "second", "side", "rep", "digest")
    tasks = checkpoint(inside.union(crossing)).withColumnRenamed("rep", "doc_id")
    # of rows that repeat both id and set, each is sent; they are the same to the search
    sent = lookup(sets.filter("short IS NOT NULL").select("doc_id", "digest", "shingles", "short"), tasks, ["digest", "doc_id"])

    def link(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["doc_id", "digest"]).sort_values("doc_id", kind="stable")
        sets_, short = [np.frombuffer(s, "u8") for s in f["shingles"]], [np.asarray(s, "i8").view("u8") for s in f["short"]]
        ids = f["doc_id"].to_numpy()
        pairs = search(sets_, short, f["side"].to_numpy(), percent)
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, dtype="int64")

    links = sent.groupBy("first", "second").applyInPandas(link, "a long, b long")
    joined = components(links).select(F.col("node").alias("rep"), "component")
    member = classes.join(joined, "rep", "left").select("digest", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "digest").join(member, ["digest", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("copies")).alias("copies"))


def one_of_each(docs: DataFrame, percent: int = 80, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all columns, whose id is the smallest of its component; rows that share an id stay or go together, null ids stay."""
    found = similar_documents(docs, percent, size, doc_id, text)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(doc_id).cast("long").alias("_id"))
    kept = whole.join(first, F.col("_id") == F.col("_first"), "left_semi")
    return kept.select("row").union(whole.filter("_id IS NULL").select("row")).select("row.*")
