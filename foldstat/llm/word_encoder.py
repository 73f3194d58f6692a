"""Batch encoding with a ``tokenizers`` BPE file by way of its distinct words.

A BPE file of this kind splits a text at white space before any merge, so the ids
of a text are the ids of its white-space-separated chunks in turn. The chunks of a
batch are dictionary-encoded by Arrow; each distinct one is encoded once by the
library and remembered, and the ids of the batch are one ragged gather. Chunks that
are new are learnt together: letters and the marks after them are told apart first,
so that ``word`` and ``Word,`` share one call of the library's model.

Special tokens are the library's: their strings in a text are their ids, as
``encode(text, add_special_tokens=False)`` gives them. The memory is bounded, which
changes speed only.
"""

from __future__ import annotations

import gc
import json
import os
import string
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import SPACE, give_back, text_buffer, word_spans
from .ragged import Lists

#: Chunks of a generation remembered at most, and half the pieces of chunks.
MEMO = 250_000
# A-Z as a-z.
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # The short cut below holds for this chain of steps alone; any other file takes the library's whole path for each chunk.
        plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        if not plain and not (spec.get("pre_tokenizer") or {}).get("type"):
            raise ValueError("this file does not split texts at white space")
        if any(" " in t["content"] or "\n" in t["content"] for t in spec.get("added_tokens", [])):
            raise ValueError("a special token of this file spans white space")
        self.split = regex.compile(splits[0]["pattern"]["Regex"]) if plain else None
        # Composed, no white space, of one lower-case character: NFC and the space rule leave these alone. Special tokens begin with "<".
        self.latin = regex.compile("[\x21-\x3b\x3d-\x7e\xa1-\u012f\u0131-\u024f]*").fullmatch
        if any(not t["content"].startswith("<") for t in spec.get("added_tokens", [])):
            self.split = None
        self.pieces: dict[str, list[int]] = {}
        self.chunks = Lists("I", self._learnt, MEMO)

    def _learnt(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each of these chunks."""
        pieces, latin, marks = self.pieces, self.latin, string.punctuation
        cut: list[tuple | list[str] | None] = []
        for chunk in chunks:
            body = chunk.rstrip(marks)
            if self.split is None:
                cut.append(None)
            elif body.isalpha() and (body.isascii() or latin(body)):  # letters, then at most one run of marks
                cut.append((body.lower(),) if len(body) == len(chunk) else (body.lower(), chunk[len(body) :]))
            else:
                cut.append(self.split.findall(chunk.lower()) if latin(chunk) else None)
        tokenize = self.model.tokenize
        for piece in set(chain.from_iterable([own for own in cut if own])).difference(pieces):
            pieces[piece] = [t.id for t in tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS))]
        rest = [c for c, own in zip(chunks, cut, strict=True) if own is None]
        whole = iter([e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
        out = []
        for own in cut:
            if own is None:
                out.append(next(whole))
            elif len(own) == 1:
                out.append(pieces[own[0]])
            else:
                out.append([i for piece in own for i in pieces[piece]])
        return out

    def forget(self) -> None:
        """Give the memory back. Workers outlive their tasks, and what one stage leaves in them is missing in the next."""
        self.pieces.clear()
        self.chunks = Lists("I", self._learnt, MEMO)
        give_back()

    def encode(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn as uint32, offsets of the texts among them); ``end`` is appended to each."""
        self.chunks.turn()
        if len(self.pieces) > 2 * MEMO:
            self.pieces.clear()
        raw, at = text_buffer(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        starts, ends, first = word_spans(raw, at)
        if self.split is not None:
            # Texts up to U+00FF without "<" are lower-cased here, as far as A-Z: no mark composes with a letter there, and no special token occurs.
            odd = np.unique(np.searchsorted(at, np.flatnonzero((raw >= 0xC4) | (raw == 0x3C)), "right") - 1)
            low = _LOW[raw]
            for i in odd.tolist():
                low[at[i] : at[i + 1]] = raw[at[i] : at[i + 1]]
            raw = low
        sizes = ends - starts
        bounds = np.r_[0, np.cumsum(sizes)]
        letters = raw[~SPACE[raw]]  # words are all that is no white space
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
        gc.disable()  # many small lists and no cycles: looking for some would take a fifth of the time
        try:
            distinct = self.chunks.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        finally:
            gc.enable()
        ids, places = self.chunks.store.gather(distinct[np.asarray(words.indices)] if len(starts) else distinct)
        offsets = places[first]
        if end is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def _byte_chars() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()

_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
