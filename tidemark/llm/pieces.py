"""SentencePiece BPE, encoded and decoded as the ``sentencepiece`` library does it, inside tasks.

A text is cut where no piece of the model can lie across: before spaces, at line ends, between letters and a mark behind
them. What is left, words, is encoded once per worker: the words a batch brings anew lie one behind the other in flat
arrays of symbols, and every round finds the best pair of each word and merges it in all words at once, leftmost first,
until no word has a pair left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import binary_array, column, text_batches, worker_state

SPACE = "▁"
#: What the library writes for an unknown id, and for bytes that are no text.
UNKNOWN, BROKEN = " ⁇ ", "�"
#: Words a worker remembers, and their longest; when full, it starts anew. Bounds memory, not results.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of a text that are cut into words at once.
STRETCH = 1_000_000
#: Symbols from here on are characters without a piece.
CHARS = 1 << 22
NONE = np.iinfo("i4").max
#: Marks after which or before which words are cut, where the vocabulary allows it.
MARKS = ".,;:!?\n"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"


class PairTable:
    """Whole numbers by pairs of whole numbers below 2**23: open addressing in flat arrays, looked up many at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        bits = max(4, int(np.ceil(np.log2(8 * len(pairs) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.probes = np.full(1 << bits, -1, "i8"), np.full(1 << bits, -1, "i4"), 1
        keys = np.array([a << 23 | b for a, b in pairs], "i8")
        for key, at, value in zip(keys.tolist(), self._home(keys).tolist(), pairs.values(), strict=True):
            steps = 1
            while self.keys[at] >= 0:
                at, steps = (at + 1) & self.mask, steps + 1
            self.keys[at], self.values[at], self.probes = key, value, max(self.probes, steps)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view("i8")

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where there is none."""
        keys = first.astype("i8") << 23 | second
        at = self._home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            here = (at[open_] + step) & self.mask
            found = self.keys[here] == keys[open_]
            out[open_[found]] = self.values[here[found]]
            open_ = open_[~found & (self.keys[here] >= 0)]
        return out


class PieceModel:
    """A SentencePiece BPE model with byte fallback and without text normalisation."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds, how = proto.ModelProto.SentencePiece, spec.normalizer_spec
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces")
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are")
        self.prefix = " " if how.add_dummy_prefix else ""
        self.begin, self.end = (next(i for i, p in enumerate(spec.pieces) if p.piece == name) for name in (spec.trainer_spec.bos_piece or "<s>", spec.trainer_spec.eos_piece or "</s>"))
        self.size = len(spec.pieces)
        self.byte_ids = np.zeros(256, "i4")
        self.surface: list[bytes] = []
        self.byte = np.zeros(self.size, bool)
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.byte[i] = i, True
                self.surface.append(bytes([value]))
            else:
                self.surface.append(b"" if p.type == kinds.CONTROL else UNKNOWN.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in spec.pieces])
        self.control = np.array([p.type == kinds.CONTROL for p in spec.pieces])
        # equal scores are equal ranks; the highest score is rank 0
        self.rank = np.unique([-p.score for p in spec.pieces], return_inverse=True)[1].astype("i4")
        self.chars = (np.arange(0x110000) + CHARS).astype("i4")
        symbol = dict(normal)
        for piece in normal:
            for c in piece:
                symbol.setdefault(c, CHARS + ord(c))
        for c, i in symbol.items():
            if len(c) == 1:
                self.chars[ord(c)] = i
        joins, beside = {}, {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                beside[(ord(piece[k - 1]), ord(piece[k]))] = 1
                if piece[:k] in symbol and piece[k:] in symbol:
                    joins[(symbol[piece[:k]], symbol[piece[k:]])] = i
        self.joins, self.beside = PairTable(joins), PairTable(beside)
        self.words = self._words(beside)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _words(beside: Iterable[tuple[int, int]]) -> re.Pattern:
        """A pattern for the longest stretches worth remembering: it only cuts where no piece has both neighbours."""
        met = {(chr(a), chr(b)) for a, b in beside}
        if any(b == SPACE != a for a, b in met):
            return re.compile(r".+", re.S)  # pieces of several words: whole texts
        line = "\\n" if not any("\n" in pair for pair in met) else ""
        ends = [m for m in MARKS if not any(b == m and re.match(f"[{_LETTER}]", a) for a, b in met)]
        cut = rf" *[{_LETTER}]++(?=[{re.escape(''.join(ends))}])|" if ends else ""
        return re.compile(rf"{cut} *[^ {line}]+| +" + ("|\\n" if line else ""))

    # -- encoding ------------------------------------------------------------------------------------------

    def merge_rounds(self, sym: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The symbols of many words after all merges; -1 where a symbol was merged into one before it.

        ``last`` marks the last symbol of each word. In a round each word merges its pair of the smallest rank: all
        its places, from the left, up to a merge that gives rise to a pair of no larger rank, whose turn is then next.
        """
        out = np.full(len(sym), -1, "i4")
        sym, last, pos = sym.astype("i4"), last.copy(), np.arange(len(sym))

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at_ = np.minimum(at + 1, len(sym) - 1)
            new = np.where(last[at], -1, self.joins.find(sym[at], sym[at_]))
            return new, np.where(new >= 0, self.rank[new], NONE)

        if not len(sym):
            return out
        new, rank = pairs(np.arange(len(sym)))
        while True:
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, sizes)
            if not live.all():  # words without a pair are done
                out[pos[~live]] = sym[~live]
                if not live.any():
                    return out
                sizes, best = sizes[best < NONE], best[best < NONE]
                sym, last, pos, new, rank = (a[live] for a in (sym, last, pos, new, rank))
            word = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(rank == best[word])
            run = np.concatenate(([True], np.diff(hit) != 1))  # of pairs that overlap every second one stays
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            made, at_word = new[hit], word[hit]
            follows = np.concatenate(([False], np.diff(hit) == 2)) & np.concatenate(([False], np.diff(at_word) == 0))
            left = np.where(follows, np.concatenate(([0], made[:-1])), sym[np.maximum(hit - 1, 0)])
            has_left = (hit > 0) & ~last[np.maximum(hit - 1, 0)]
            has_right = ~last[hit + 1]
            a = np.where(has_left, self.joins.find(left, made), -1)
            b = np.where(has_right, self.joins.find(made, sym[np.minimum(hit + 2, len(sym) - 1)]), -1)
            least = np.minimum(np.where(a >= 0, self.rank[a], NONE), np.where(b >= 0, self.rank[b], NONE))
            turns = least <= best[at_word]
            if turns.any():
                before = np.cumsum(turns) - turns
                first = np.concatenate(([True], np.diff(at_word) != 0))
                base = before[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
                hit, made = hit[before == base], made[before == base]
            sym[hit], last[hit] = made, last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, last, pos, new, rank = (a[keep] for a in (sym, last, pos, new, rank))
            here = hit - np.arange(len(hit))
            for at in (here, here[here > 0] - 1):
                new[at], rank[at] = pairs(at)

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word (4 bytes each), spaces as spaces."""
        code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4").astype("i8")
        if not len(code):
            return [b""] * len(words)
        ends = np.cumsum([len(w) for w in words])
        last = np.ones(len(code), bool)
        last[:-1] = self.beside.find(code[:-1], code[1:]) < 0
        last[ends[ends > 0] - 1] = True
        sym = self.merge_rounds(self.chars[code], last)
        at = np.flatnonzero(sym >= 0)
        sym, ends = sym[at], np.searchsorted(at, ends)
        bare = np.flatnonzero(sym >= CHARS)  # characters without a piece become bytes
        raw = [chr(c).encode() for c in (sym[bare] - CHARS).tolist()]
        sizes = np.ones(len(sym), "i8")
        sizes[bare] = [len(r) for r in raw]
        ids = np.repeat(sym, sizes)
        if len(bare):
            first = np.cumsum(sizes) - sizes
            width = sizes[bare]
            places = np.repeat(first[bare], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            ids[places] = self.byte_ids[np.frombuffer(b"".join(raw), "u1")]
        ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]

    def _stretches(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            to = min(at + STRETCH, len(text))
            if to < len(text):  # on to where a word begins
                found = re.compile(r"(?<! ) ").search(text, to)
                to = found.start() if found else len(text)
            yield self.words.findall(text, at, to)
            at = to

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text with begin and end ids; null and empty texts have these alone."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        parts: list[list[str]] = []
        for t in texts:
            parts.append([])
            if t:
                for words in self._stretches(self.prefix + t.replace(SPACE, " ")):
                    parts[-1] += words
        met = {w for words in parts for w in words}
        fresh = list(met.difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, list(met)
        self.known.update(zip(fresh, self.encode_words(fresh), strict=True))
        out = [np.frombuffer(begin + b"".join(map(self.known.__getitem__, words)) + end, "<u4") for words in parts]
        for w in fresh:
            if len(w) > LONGEST:
                del self.known[w]
        return out

    # -- decoding ------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, spaces for their mark, the space put before a text taken off, bytes as UTF-8."""
        shown = ids[~self.control[ids]]
        if not len(shown):
            return ""
        raw = b"".join(map(self.surface.__getitem__, shown.tolist()))
        if not self.byte[shown[0]] and self.spaced[shown[0]] and self.prefix:
            raw = raw[1:]
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(shown)
        return text

    def _decode_broken(self, shown: np.ndarray) -> str:
        """Runs of byte pieces that are no text: each byte that cannot be read is a replacement character."""
        out: list[str] = []
        edges = np.flatnonzero(np.diff(self.byte[shown].astype("i1"))) + 1
        for part in np.split(shown, edges):
            raw = b"".join(map(self.surface.__getitem__, part.tolist()))
            if not self.byte[part[0]]:
                out.append(raw.decode()[1 if not out and self.spaced[part[0]] and self.prefix else 0 :])
                continue
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(BROKEN)
                    at += 1
        return "".join(out)


def piece_model(path: str) -> PieceModel:
    """The worker's model for a file; loaded once per worker."""
    held = worker_state("pieces").setdefault("models", {})
    if path not in held:
        held[path] = PieceModel(path)
    return held[path]


def _schema(docs: DataFrame, doc_id: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(n, t) for n, t in more.items()]])


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (4 bytes each, little-endian) of whole texts, with begin and end ids.

    With ``decoded`` also the text that ``decode`` gives back for the ids, made in the same pass. Null and empty texts
    have begin and end ids alone; null and repeated ids and repeated rows are encoded each; other columns are ignored;
    no documents, no rows. Texts are worked on a batch at a time, a long one by itself, in stretches.
    """
    schema = _schema(docs, doc_id, n_tokens=T.LongType(), ids=T.BinaryType(), **({"decoded": T.StringType()} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in text_batches(batches, 1_000_000):
            ids = m.encode(b.column(1).to_pylist())
            sizes = np.array([len(i) for i in ids], "i8")
            cols = [b.column(0), pa.array(sizes), binary_array(np.concatenate(ids), np.cumsum(sizes))]
            if decoded:
                cols.append(pa.array([m.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the texts of ids (4 bytes each, little-endian), any ids of the model in any order.

    Begin and end ids give nothing, an unknown one its sign, bytes that are no text replacement characters; null ids
    give a null text; other columns are ignored.
    """
    schema = _schema(docs, doc_id, decoded=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in text_batches(batches):
            texts = [None if x is None else m.decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return docs.select(column(doc_id).alias("doc_id"), column(ids).alias("ids")).mapInArrow(run, schema)
