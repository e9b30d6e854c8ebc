"""Collocations from a weighted de Bruijn graph of words.

Runs of ``longest`` words are edges between the runs of one word less that they begin and end with. Counts of shorter
runs are never taken from the texts again: a node's count is the flow out of it, which is the weight of its edges plus
what ends with it at the end of a piece. What can be no candidate is found first, by hashes, and travels no further than
its chunk: a chunk adds its rare edges out of a node to the node's end. Edges in a row, with one way in, one way out and
one weight in their chunk, travel as one path.

Hashes only choose what to send; all counts are of words themselves.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import answers, exchange, mixed, n_buckets
from tidemark.llm.common import checkpoint, column, parallelism, text_batches

#: Between pieces in a chunk; no word holds it.
BREAK = b"."
#: Lower case of the letters A to Z alone; what ends a piece becomes a break, a tab a space.
BYTES = bytes(c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else BREAK[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Language of rows without one.
NO_LANG = "und"
CHUNK_SCHEMA = "chunk long, lang string, n_bytes long, data binary"
ROWS_SCHEMA = "lang string, words int, phrase string, weight long"


def word_chunks(docs: DataFrame, most: int = 2_000_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Texts as compressed chunks of about ``most`` bytes in one language, kept in the checkpoint folder.

    A longer text is cut between pieces; a longer piece stays whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def chunk(name: str) -> pa.RecordBatch:
            nonlocal number
            raw = BREAK.join(held.pop(name))
            number += 1
            values = [(part << 32) + number, name, size.pop(name), pack.compress(raw)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "lang", "n_bytes", "data"])

        for b in text_batches(batches, most):
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part_ in _parts((t or "").encode().translate(BYTES), most):
                    held.setdefault(name, []).append(part_)
                    size[name] = size.get(name, 0) + len(part_)
                    if size[name] >= most:
                        yield chunk(name)
            while sum(size.values()) > 4 * most:  # many languages: the fullest goes
                yield chunk(max(size, key=size.get))
        for name in list(held):
            yield chunk(name)

    d = docs.select(F.coalesce(column(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), column(text).alias("text"))
    return checkpoint(d.mapInArrow(run, CHUNK_SCHEMA))


def _parts(raw: bytes, most: int) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > most and (to := raw.find(BREAK, at + most)) >= 0:
        yield raw[at:to]
        at = to + 1
    if len(raw) > at:
        yield raw[at:]


@dataclass
class Level:
    """Distinct runs of one length in a chunk: where one begins, its count, the runs it begins and ends with, a hash."""

    first: np.ndarray
    count: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    hash: np.ndarray


class ChunkGraph:
    """Runs of up to ``longest`` words of a chunk, exactly, and their hashes, which tell languages apart."""

    def __init__(self, lang: str, data: bytes, longest: int) -> None:
        # all white space that is left is spaces
        self.words = zstandard.ZstdDecompressor().decompress(data).replace(BREAK, b" " + BREAK + b" ").split()
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(number.__getitem__, self.words), "i8", len(self.words))
        gap = ids == number.get(BREAK, -1)
        n, seed = len(ids), xxhash.xxh64_intdigest(lang)
        ends = np.append(np.flatnonzero(gap), n)
        run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words up to the end of the piece
        self.n_words = int((~gap).sum())
        of_word = np.array([xxhash.xxh64_intdigest(w, seed) for w in number], "u8")
        self.levels: list[Level] = []
        rank = np.full(n, -1, "i8")
        for k in range(1, longest + 1):
            at = np.flatnonzero(run >= k)
            key = ids[at] if k == 1 else rank[at] * len(number) + ids[at + k - 1]
            order = np.argsort(key)
            new = np.concatenate(([True], np.diff(key[order]) != 0))[: len(order)]
            begin = np.flatnonzero(new)
            first, count = at[order[begin]], np.diff(np.append(begin, len(order)))
            if k == 1:
                self.levels.append(Level(first, count, np.empty(0, "i8"), np.empty(0, "i8"), mixed(of_word[ids[first]])))
            else:
                before = self.levels[-1]
                prefix, suffix = rank[first], rank[first + 1]
                h = mixed(before.hash[prefix] * np.uint64(0x9E3779B97F4A7C15) + of_word[ids[first + k - 1]] + np.uint64(k))
                self.levels.append(Level(first, count, prefix, suffix, h))
            rank = np.full(n, -1, "i8")
            rank[at[order]] = np.cumsum(new) - 1

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct sorted hashes of runs of all lengths, and for each run the place of its hash."""
        return np.unique(np.concatenate([lv.hash for lv in self.levels]), return_inverse=True)

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.words[at : at + k])

    def rows(self, frequent: list[np.ndarray]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """``(k, phrases, weights)``: paths of edges (``k`` the longest) and what flows out of nodes other than by these.

        ``frequent`` marks the runs of each level that may be candidates; those with a rare part do not count.
        """
        marks = [frequent[0]]
        for lv, f in zip(self.levels[1:], frequent[1:], strict=True):
            marks.append(f & marks[-1][lv.prefix] & marks[-1][lv.suffix])
        for k in range(1, len(self.levels)):
            lv, up, here = self.levels[k - 1], self.levels[k], marks[k - 1]
            edges = marks[k]
            out = np.bincount(up.prefix[edges], up.count[edges], len(lv.count)).astype("i8")
            rest = lv.count - out
            at = np.flatnonzero(here & (rest > 0))
            yield k, [self.phrase(i, k) for i in lv.first[at].tolist()], rest[at]
        yield len(self.levels), *self._paths(marks[-1])

    def _paths(self, mark: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        k, lv = len(self.levels), self.levels[-1]
        edge = np.flatnonzero(mark)
        if k == 1:
            return [self.phrase(i, 1) for i in lv.first[edge].tolist()], lv.count[edge]
        nodes = len(self.levels[-2].count)
        tail, head, weight = lv.prefix[edge], lv.suffix[edge], lv.count[edge]
        into, out = np.bincount(head, minlength=nodes), np.bincount(tail, minlength=nodes)
        only_out = np.full(nodes, -1, "i8")
        only_out[tail] = np.arange(len(edge))
        follow = np.where((into[head] == 1) & (out[head] == 1), only_out[head], -1)
        follow = np.where((follow >= 0) & (weight[follow] == weight), follow, -1)  # unary and of one weight
        led = np.zeros(len(edge), bool)
        led[follow[follow >= 0]] = True
        phrases, weights, done = [], [], np.zeros(len(edge), bool)
        nexts, firsts = follow.tolist(), lv.first[edge].tolist()
        for e in [*np.flatnonzero(~led).tolist(), *np.flatnonzero(led).tolist()]:  # the latter only where paths are rings
            if done[e]:
                continue
            words, x = self.words[firsts[e] : firsts[e] + k], e
            done[e] = True
            while (x := nexts[x]) >= 0 and not done[x]:
                done[x] = True
                words.append(self.words[firsts[x] + k - 1])
            phrases.append(b" ".join(words))
            weights.append(weight[e])
        return phrases, np.array(weights, "i8")


def _sub(words: Column, k: int) -> Column:
    """All runs of ``k`` words of an array, as strings."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, words, phrase, f``: exact counts of all runs of 1 to ``longest`` words that occur ``least`` times or more.

    Also ``words = 0`` and the empty phrase: the number of all words of a language. Counts are summed where they are
    made first; a run that all chunks share is one row per task. Written to the checkpoint folder.
    """
    chunks = word_chunks(docs, text=text, lang=lang)

    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        g = ChunkGraph(row["lang"], row["data"], longest)
        keys, at = g.keys()
        counts = np.bincount(at, np.concatenate([lv.count for lv in g.levels]), len(keys)).astype("i8")
        return keys, np.minimum(counts, least)  # no more is needed to tell

    def answer(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
        sizes = [len(k) for k in keys]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], np.diff(every[order]) != 0)))
        total = np.add.reduceat(np.concatenate(counts)[order], begin)
        out = np.empty(len(every), "u1")
        out[order] = np.repeat(total >= least, np.diff(np.append(begin, len(every))))
        return np.split(out, np.cumsum(sizes)[:-1])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = ChunkGraph(row["lang"], row["data"], longest)
                keys, at = g.keys()
                known = answers(row["replies"]).astype(bool)
                frequent = np.split((known if len(known) else np.zeros(len(keys), bool))[at], np.cumsum([len(lv.hash) for lv in g.levels])[:-1])
                for k, phrases, weights in [(0, [b""], np.array([g.n_words])), *g.rows(frequent)]:
                    if len(phrases):
                        n = len(phrases)
                        cols = [pa.array([row["lang"]] * n, pa.string()), pa.array(np.full(n, k, "i4")), pa.array(phrases, pa.string()), pa.array(weights.astype("i8"))]
                        yield pa.RecordBatch.from_arrays(cols, names=["lang", "words", "phrase", "weight"])

    replies = exchange(chunks, keys_of, answer, n_buckets(chunks), key_bits=40)
    sent = chunks.join(replies, "chunk", "left").mapInArrow(send, ROWS_SCHEMA)
    sent = checkpoint(sent.groupBy("lang", "words", "phrase").agg(F.sum("weight").alias("weight")))
    add = F.sum("weight").alias("weight")
    edges = sent.filter(F.col("words") == longest).select("lang", F.explode(_sub(F.split("phrase", " "), longest)).alias("phrase"), "weight")
    level = edges.groupBy("lang", "phrase").agg(add)
    levels = [level.withColumn("words", F.lit(longest))]
    for k in range(longest - 1, 0, -1):
        flow = level.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "weight")
        level = checkpoint(flow.unionByName(sent.filter(F.col("words") == k).drop("words")).groupBy("lang", "phrase").agg(add))
        levels.append(level.withColumn("words", F.lit(k)))
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    out = out.unionByName(sent.filter("words = 0"))
    return checkpoint(out.filter((F.col("weight") >= least) | (F.col("words") == 0)).select("lang", "words", "phrase", F.col("weight").alias("f")))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    ``a`` is the phrase's count, at least ``least``; ``l`` and ``r`` are the counts of its two parts at the cut with the
    smallest ``floor(1000000 * a * a / (l * r))``, which is ``score``; of equal ones the first cut counts. A phrase goes
    where a longer candidate around it has ``share`` percent of its count or more. Ties go to the larger count, then to
    the phrase that is first in UTF-8. ``top`` None returns all.

    Null and empty texts have no words; rows without a language are of language ``und``; repeated rows count each; other
    columns are ignored; a language without candidates, and an empty table, give no rows.
    """
    counts = phrase_counts(docs, longest, least, text, lang)
    f = counts.filter("words > 0").select("lang", "words", "phrase", "f")
    found = f.filter("words > 1").withColumnRenamed("f", "a")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    part = found.select("lang", "phrase", "words", "a", cuts.alias("k"))
    part = part.withColumns({"_left": F.expr("substring_index(phrase, ' ', k)"), "_right": F.expr("substring_index(phrase, ' ', k - words)")})
    part = part.join(f.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    part = part.join(f.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    # counts below 10**15: no product passes 38 digits
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = part.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    around = found.filter("words > 2")
    inside = None
    for k in range(2, longest):
        rows = around.filter(F.col("words") > k).select("lang", F.explode(F.array_distinct(_sub(F.split("phrase", " "), k))).alias("phrase"), "a")
        inside = rows if inside is None else inside.unionByName(rows)
    if inside is not None:
        inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
        best = best.join(inside, ["lang", "phrase"], "left").filter(F.col("_most").isNull() | (100 * F.col("_most") < share * F.col("a")))
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    out = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the best of each of some shares of a language, then of all these
        shares = F.pmod(F.xxhash64("phrase"), F.lit(parallelism(docs.sparkSession)))
        out = out.withColumn("_share", shares)
        out = out.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("_nth") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
