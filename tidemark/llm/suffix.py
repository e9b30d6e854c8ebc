"""Removal of long repeated byte strings through a logarithmic family of sorted suffix indexes.

Every string of ``length`` bytes holds, among its ``GRAM``-byte strings, one with the smallest hash, at the same place
wherever the string occurs. Suffixes that start at such anchors are the sparse suffix array of a batch of texts (a
chunk): about one place in fourteen, and still no repeat is missed. An index entry is the fingerprint of the whole
stretch of strings the anchor stands for, beside it a part of the anchor's, and the smallest document that has it.

Batches enter as the smallest level; two levels of like size merge into one of twice the size, so a bucket holds
logarithmically many and a key is moved as often. When the last batch is in, the levels merge into one and each batch is scanned against it: a stretch that a smaller document has is a
repeat as a whole; one whose anchor alone recurs (the ends of repeated passages) is looked up string by string, in a
second exchange of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.chunks import Chunk, answers, byte_codes, chunk_table, exchange, joined, mixed, n_buckets
from tidemark.llm.common import checkpoint, worker_state

#: Bytes of the strings that compete for an anchor. Shorter ones recur by chance, longer ones make more anchors.
GRAM = 24
#: Places worked on at a time.
STEP = 1 << 16
#: Bits of an anchor's hash that travel beyond the bucket's, beside the 64 of the stretch's.
LEAD_BITS = 32
UNIQUE, REPEAT, LOOK_UP = 0, 1, 2
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>"


Level = tuple[np.ndarray, np.ndarray]


def _distinct(keys: np.ndarray, docs: np.ndarray, order: np.ndarray) -> tuple[Level, np.ndarray]:
    """Distinct keys in ``order`` with the smallest document of each; marks where a key begins."""
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new)) if len(k) else docs
    return (k[new], least), new


def merged(a: Level, b: Level) -> Level:
    """Two sorted levels as one; the stable sort merges their runs."""
    keys, docs = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    return _distinct(keys, docs, np.argsort(keys, kind="stable"))[0]


class Family:
    """Levels of geometrically growing sizes: sorted keys, and the smallest document of each."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            last = self.levels.pop()
            self.levels.append(merged(self.levels.pop(), last))

    def whole(self) -> Level:
        """All levels as one, smallest first."""
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels.append(merged(self.levels.pop(), last))
        return self.levels[0]


def _whole(keys: Sequence[np.ndarray], docs: Sequence[np.ndarray]) -> Level:
    family = Family()
    for k, d in zip(keys, docs, strict=True):
        family.add(k, d)
    return family.whole()


def judge_stretches(keys: Sequence[np.ndarray], docs: Sequence[np.ndarray], leads: Sequence[np.ndarray]) -> list[np.ndarray]:
    """A key is a whole stretch's; its lead, the anchor's, may recur with other stretches.

    Leads of two anchors that are alike by chance only make more strings to look up.
    """
    own, least = _whole(keys, docs)
    found = [np.searchsorted(own, k) for k in keys]
    lead = np.empty(len(own), "u4")
    for at, x in zip(found, leads, strict=True):
        lead[at] = x
    order = np.argsort(lead)
    next_ = np.diff(lead[order]) == 0
    recurs = np.empty(len(own), bool)
    recurs[order] = np.concatenate(([False], next_)) | np.concatenate((next_, [False]))
    return [np.where(least[at] < d, REPEAT, np.where(recurs[at], LOOK_UP, UNIQUE)) for at, d in zip(found, docs, strict=True)]


def judge_strings(keys: Sequence[np.ndarray], docs: Sequence[np.ndarray]) -> list[np.ndarray]:
    own, least = _whole(keys, docs)
    return [np.where(least[np.searchsorted(own, k)] < d, REPEAT, UNIQUE) for k, d in zip(keys, docs, strict=True)]


class Suffixes:
    """Anchors of a chunk: ``first`` and ``last`` place of the strings each stands for, its ``key`` and its document."""

    def __init__(self, c: Chunk, length: int) -> None:
        worker_state("suffix")
        self.length, n = length, len(c.data)
        codes, wide, places = byte_codes(), length - GRAM + 1, max(n - length + 1, 0)
        self.gram, at = np.empty(places + wide - 1 if places else 0, "u8"), np.empty(places, "i4")
        for low in range(0, places, STEP):  # pieces that fit the cache
            high = min(low + STEP, places)
            one = codes[c.data[low : high + length - 1]]
            two = joined(one, 1, one, 1)
            four = joined(two, 2, two, 2)
            eight = joined(four, 4, four, 4)
            gram = joined(joined(eight, 8, eight, 8), 16, eight, 8)
            self.gram[low : low + len(gram)] = gram
            best, place, span = mixed(gram), np.arange(len(gram), dtype="i4"), 1
            while span < wide:  # strings compared so far, of those in a window
                step = min(span, wide - span)
                less = best[step:] < best[:-step]
                best, place = np.where(less, best[step:], best[:-step]), np.where(less, place[step:], place[:-step])
                span += step
            at[low:high] = place + low
        whole = np.zeros(places + 1, bool)  # places where a string fits into its document
        for s, e in zip(c.starts, c.ends, strict=True):
            if e - s >= length:
                whole[s : e - length + 1] = True
        place = np.flatnonzero(whole[:-1])
        anchor = at[place]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1))) if len(place) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        self.first, self.last = place[begin], place[np.append(begin[1:], len(place)) - 1] if len(place) else place
        a = anchor[begin]
        self.doc = np.searchsorted(c.ends, self.first, "right")
        self.docs = c.ids
        stretch = mixed(self.strings(self.first) * np.uint64(3) + self.strings(self.last) + (a - self.first).astype("u8") * np.uint64(0x5851F42D4C957F2D) + (self.last - self.first).astype("u8"))
        # hashed once more: anchors have the smallest hashes, and buckets are cut from the key's first bits
        self.key, self.stretch = mixed(mixed(self.gram[a])), stretch

    def strings(self, place: np.ndarray) -> np.ndarray:
        """Hashes of the strings of ``length`` bytes at these places."""
        h = mixed(self.gram[place])
        for k in range(GRAM, self.length - GRAM, GRAM):
            h = mixed(h + self.gram[place + k])
        return mixed(h + self.gram[place + (self.length - GRAM)])


def _unique(keys: np.ndarray, docs: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ``order``, the smallest document of each, for each input row where its key is, and a row of each key."""
    (own, least), new = _distinct(keys, docs, order)
    back = np.empty(len(keys), "i8")
    back[order] = np.cumsum(new) - 1
    return own, least, back, order[new]


def _stretch_keys(s: Suffixes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a chunk's stretches, all 64 bits of their hashes whatever the number of buckets; documents, places of keys as from ``_unique``, and the anchors' keys, which choose the bucket."""
    order = np.argsort(s.stretch)
    order = order[np.argsort(s.key[order] >> np.uint64(64 - (buckets.bit_length() - 1)), kind="stable")]
    own, least, back, row = _unique(s.stretch, s.docs[s.doc], order)
    return own, least, back, s.key[row]


def _string_keys(s: Suffixes, verdict: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the strings that need a look, then keys, documents and places of keys as from ``_unique``."""
    at = np.flatnonzero(verdict == LOOK_UP)
    many = s.last[at] - s.first[at] + 1
    place = np.repeat(s.first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    keys = s.strings(place)
    return place, *_unique(keys, s.docs[np.repeat(s.doc[at], many)], np.argsort(keys))[:3]


def repeated_strings(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What is left of every text without bytes of strings that start in a document before.

    A byte goes if a string of ``length`` bytes that covers it also occurs in a document with a smaller id. Strings are
    bytes of UTF-8 and lie within one document; they are judged on the input. Returns ``doc_id, n_bytes, n_removed,
    n_spans, kept`` (bytes) and the removed spans ``starts, ends``.

    Null texts are empty. Rows that repeat an id do not take from one another; null ids come before all others and
    neither do they; other columns are ignored; no documents, no rows. Strings and stretches are compared by 64-bit
    hashes, at every size of input.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    chunks = chunk_table(docs, 1_000_000, doc_id, text)
    buckets = n_buckets(chunks)

    def stretches(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, first, _, leads = _stretch_keys(Suffixes(Chunk(row), length), buckets)
        return keys, first, leads

    def verdicts(row: dict) -> tuple[Suffixes, np.ndarray]:
        s = Suffixes(Chunk(row), length)
        _, first, back, _ = _stretch_keys(s, buckets)
        got = answers(row["replies"])[back] if len(back) else np.empty(0, "u1")
        return s, np.where(s.docs[s.doc] > first[back], REPEAT, got) if len(back) else got

    def strings(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return _string_keys(*verdicts(row))[1:3]

    first = exchange(chunks, stretches, judge_stretches, buckets, lead_bits=LEAD_BITS)
    judged = checkpoint(first)
    chunks = chunks.join(judged, "chunk", "left")
    second = exchange(chunks, strings, judge_strings, buckets).withColumnRenamed("replies", "strings")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                c = Chunk(row)
                s, verdict = verdicts(row)
                place, _, smallest, back = _string_keys(s, verdict)
                got = answers(row["strings"])[back] if len(back) else np.empty(0, "u1")
                owner = s.docs[np.searchsorted(c.ends, place, "right")]
                place = place[(got == REPEAT) | (owner > smallest[back])] if len(back) else place
                whole = verdict == REPEAT
                change = np.zeros(len(c.data) + 1, "i4")
                np.add.at(change, s.first[whole], 1)
                np.add.at(change, s.last[whole] + length, -1)
                np.add.at(change, place, 1)
                np.add.at(change, place + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                cols = [[], [], [], [], [], []]
                for x, y in zip(c.starts, c.ends, strict=True):
                    g = gone[x:y]
                    edge = np.diff(np.concatenate(([0], g.view("i1"), [0])))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    for col, v in zip(cols, (int(y - x), int((end - begin).sum()), len(begin), c.data[x:y][~g].tobytes(), begin, end), strict=True):
                        col.append(v)
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([c.doc_ids(), *[pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in RESULT.split(", ")])

    return chunks.join(second, "chunk", "left").mapInArrow(remove, RESULT)
