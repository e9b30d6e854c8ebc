"""Token ids of whole texts, inside tasks.

The ids are those of the ``tokenizers`` library with ``add_special_tokens=False`` and otherwise its defaults. A byte-level BPE vocabulary encodes each piece of the
pre-tokenizer's split by itself, so that for texts of common letters the split runs as a regular expression and the
library's model encodes only words that the worker has not met; all other texts, those that hold an added token of the
vocabulary, and all other kinds of vocabulary go to the library whole. The tests hold both ways against each other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

from tidemark.llm.common import worker_state

#: Words a worker remembers; when full, it starts anew. Bounds memory, not results.
REMEMBERED = 350_000
#: Letters below U+0250.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Fixed value: the split of byte-level BPE, for texts of the characters of ``PLAIN``; the commonest case comes first.
SPLIT = rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+"
#: Characters of which all libraries think the same: no other letters or digits, no separators 1C-1F.
PLAIN = r"[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*"

#: Fixed value: how byte-level vocabularies write the 256 bytes: printable Latin-1 as itself, the others from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = dict(zip([b for b in range(256) if b not in _SELF], range(0x100, 0x200)))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.find, self.plain = re.compile(SPLIT).findall, re.compile(PLAIN).fullmatch
        self.code = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.current: set[str] = set()

    def _learn(self, words: list[str]) -> None:
        """Make ``known`` hold these words; of the others it keeps those met lately."""
        if len(self.known) + len(words) > REMEMBERED:
            self.older, self.known = self.known, {}
            words = list(set(words).union(self.current))
        tokenize, older, known, code = self.tok.model.tokenize, self.older, self.known, self.code
        for w in words:
            ids = older.get(w)
            if ids is None:
                spelt = w.replace(" ", "Ġ") if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTE_CHARS)
                ids = b"".join([code[t.id] for t in tokenize(spelt)])
            known[w] = ids

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens; a null text is empty."""
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        whole = []
        for at, text in enumerate(texts):
            if not text:
                continue
            if not self.split or not self.plain(text) or any(map(text.__contains__, self.added)):
                whole.append(at)
                continue
            words = self.find(text)
            self.current = set(words)
            if len(self.current) > REMEMBERED:
                whole.append(at)
                continue
            new = self.current.difference(self.known)
            if new:
                self._learn(list(new))
            out[at] = np.frombuffer(b"".join(map(self.known.__getitem__, words)), self.dtype)
        for i in range(0, len(whole), 64):
            part = whole[i : i + 64]
            for at, e in zip(part, self.tok.encode_batch_fast([texts[j] for j in part], add_special_tokens=False), strict=True):
                out[at] = np.array(e.ids, self.dtype)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; loaded once per worker."""
    held = worker_state("tokens").setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
