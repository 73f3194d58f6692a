"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding:
of the tokens that end there, the one whose pair with the last token of the shorter
prefix before it is stable under the merges. ``PrefixTable`` stores that token for
each byte prefix. Bytes can be appended exactly, without touching what is stored;
after an edit only the prefixes near it are worked out again, up to the place where
as many stored tokens as the longest token has bytes agree. Reading the ids back from
the end is a walk over the table.

``encode`` cuts texts by the given pattern. Short pieces share one table, keyed by the
prefixes themselves, so that a piece costs only the prefixes no other piece has had.
Tables and memos are bounded; their bounds change speed only.

Defined results: a null text counts as empty, an empty text has no ids, a long one is encoded
whole. Repeated rows give repeated rows; further columns of any name are ignored. Special tokens
do not exist here: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrowed, small_batches
from .ragged import Lists, Memo, Ragged

#: Chunks of a generation, prefixes and token pairs remembered at most.
MEMO = 250_000
#: Bytes of a piece whose prefixes go to the shared table.
SHORT = 48
_SHORTEST = (2, 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.lengths = sorted({len(t) for t in ranks}, reverse=True)
        self.longest = self.lengths[0]
        self._lengths_upto = [[n for n in self.lengths if n <= i] for i in range(self.longest + 1)]
        self.ending: dict[bytes, tuple[int, ...]] = {}  # last three bytes: the lengths of tokens that end so, the longest first, then 2 and 1
        found: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        for tail, lengths in found.items():
            self.ending[tail] = (*sorted(lengths, reverse=True), 2, 1)
        self.splits = Memo(self._split)
        self.pairs = Memo(self._stable)
        self.alone = Memo(lambda i: self.merged(self.bytes_of[i]) == [i])
        self.table: dict[bytes, int] = {}  # every prefix of a prefix in it is in it

    def merged(self, data: bytes) -> list[int]:
        """The plain definition: merge the neighbours of lowest rank, leftmost first, until none is a token. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a byte."""
        data = self.bytes_of[token]
        if len(data) == 1:
            return None
        for cut in range(1, len(data)):  # the halves are themselves encodings, and stay apart until the last merge
            left, right = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
            if left is not None and right is not None and self.alone[left] and self.alone[right] and self._apart(left, right, token):
                return left, right
        raise ValueError(f"token {token} is not made by merges")

    def _stable(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of both tokens are encoded as these two."""
        left, right = pair
        return self.alone[left] and self.alone[right] and self._apart(left, right, None)

    def _apart(self, left: int, right: int, most: int | None) -> bool:
        """Whether no merge across the border of two encodings comes before those that make them (and before ``most``).

        Their last merges are undone, the later one first; a token of the pieces that then meet must not come before them.
        """
        bytes_of, ranks, splits = self.bytes_of, self.ranks, self.splits
        limit, exact = (1 << 62, True) if most is None else (most, False)  # a merge across at limit itself comes first only if it is further left
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and (across < limit or (exact and across == limit)):
                return False
            a, b = splits[left], splits[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                # The undone merge lies left of the border: of equal ranks it would come first.
                limit, exact, left = left, False, a[1]
            else:
                limit, exact, right = right, True, b[0]

    def encoded(self, data: bytes) -> list[int]:
        """The ids of a short piece, by the table that all of them share."""
        table, ranks, pairs, ending = self.table, self.ranks, self.pairs, self.ending
        known = len(data)
        while known and data[:known] not in table:
            known -= 1
        for end in range(known + 1, len(data) + 1):
            head = data[:end]
            for n in ending.get(head[-3:], _SHORTEST) if end > 2 else self._lengths_upto[end]:
                if n > end:
                    continue
                token = ranks.get(head[end - n :])
                if token is not None and (pairs[table[head[: end - n]], token] if n < end else self.alone[token]):
                    table[head] = token
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is no token")
        out, end = [], len(data)
        while end:
            token = table[data[:end]]
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]

    def bound(self) -> None:
        if len(self.table) > 4 * MEMO:
            self.table.clear()
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()

    def lengths_upto(self, n: int) -> list[int]:
        return self._lengths_upto[min(n, self.longest)]


class PrefixTable:
    """The last token of every byte prefix of one piece; ``last[i]`` ends the prefix of i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token_at(self, data: bytes, end: int) -> int:
        v = self.vocabulary
        ranks, pairs, last = v.ranks, v.pairs, self.last
        for n in v.lengths_upto(end):
            token = ranks.get(data[end - n : end])
            if token is not None:
                if n == end:
                    if v.alone[token]:
                        return token
                elif pairs[last[end - n - 1], token]:
                    return token
        raise ValueError(f"byte {data[end - 1]} is no token")

    def append(self, more: bytes) -> None:
        self.vocabulary.bound()
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._token_at(self.data, end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; returns how many prefixes were worked out again."""
        data, old = self.data[:start] + new + self.data[stop:], self.last
        shift = len(new) - (stop - start)
        self.last, self.data, same = old[:start], data, 0
        for end in range(start + 1, len(data) + 1):
            token = self._token_at(data, end)
            self.last.append(token)
            before = end - shift
            # Later tokens depend on this many bytes and stored tokens alone.
            same = same + 1 if before > stop and old[before - 1] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[before:]
                return end - start
        return len(data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class ByteEncoder:
    # A single space between two other characters always starts a match of a pattern whose words take one leading
    # space; a text can be cut there. Python's white space holds all that the pattern's does.
    _UNEVEN = re.compile(r"\s | \s|\A | \Z")
    _CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.leading = " ?" in pattern
        size = max(ranks.values()) + 1
        self.token_bytes = Ragged("B")
        self.token_bytes.extend([self.vocabulary.bytes_of.get(i, b"") for i in range(size)])
        self.pieces = Memo(self._piece)
        self.chunks = Lists("I", lambda chunks: [self._pieces(" " + c) for c in chunks], MEMO)  # a chunk stands for itself after a space

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        token = self.vocabulary.ranks.get(data)
        if token is not None:
            return [token]
        return self.vocabulary.encoded(data) if len(data) <= SHORT else PrefixTable(self.vocabulary, data).ids()

    def _pieces(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids.extend(self.pieces[piece])
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn as uint32, offsets of the texts among them)."""
        self.chunks.turn()
        self.vocabulary.bound()
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        heads, parts, bounds, words = [], [], [0], []
        for text in texts:
            if not text:
                chunks = [""]
            elif not self.leading:
                chunks = [text]
            elif self._UNEVEN.search(text):
                chunks = self._CUT.split(text)
            else:
                chunks = text.split(" ")
            heads.append(self._pieces(chunks[0]))  # the first has no space before it
            words += chunks[1:]
            bounds.append(len(words))
        ids, ends = self.chunks.gather(words)
        at = ends[np.array(bounds)]
        sizes = np.array([len(h) for h in heads], np.int64)
        offsets = at + np.r_[0, np.cumsum(sizes)]
        for head, lo, hi in zip(heads, at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts.append(np.array(head, np.uint32))
            parts.append(ids[lo:hi])
        return np.concatenate(parts) if parts else ids, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in turn, offsets of the texts among them)."""
        raw, ends = self.token_bytes.gather(ids.astype(np.int64))
        return raw, ends[offsets]


_ENCODERS: dict[tuple[str, str], ByteEncoder] = {}


def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteEncoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _binary(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and, if wanted, the bytes decoded from those ids."""
    rows = narrowed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = byte_encoder(ranks_path, pattern)
        for b in small_batches(batches):
            ids, offsets = e.encode(b.column(1).to_pylist())
            out = [b.column(0), pa.array(np.diff(offsets)), _binary(ids.astype("<u4"), offsets * 4)]
            if decoded:
                out.append(_binary(*e.decode(ids, offsets)))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "decoded"][: len(out)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of the ids of ``encode``; null ids decode as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = byte_encoder(ranks_path, pattern)
        for b in small_batches(batches):
            each = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(*e.decode(np.concatenate([*each, np.zeros(0, "<u4")]), offsets))], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")
