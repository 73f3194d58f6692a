"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, ``<s>role\\ntext</s>`` for each turn, and encoded once
with offsets. The spans of the assistant's texts are sorted, as are the token spans;
the tokens under a turn are found by binary search and cut to it, so that the mask
holds each assistant text exactly, even where a token reaches over its end.

Control strings inside roles and texts are escaped reversibly: each backslash is
doubled, and a single backslash goes between the first and second character of each
control string. A newline inside a role becomes backslash and n.

Defined results: rows of a conversation go by turn, a null turn first, ties by role
and text; a null text or role counts as empty. Rows with a null conv_id form one
conversation. A repeated row is a further turn. Further columns of any name are ignored. An empty table gives no conversation.
A task holds one conversation at a time, whatever the number of its partition's rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ending

# Control strings (fixed values): the template's own, and instruction marks that models know as such.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_ESCAPED_ROLE = re.compile(r"\\([\\n]?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts whose role is ``loss_role``."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>{escape(role).replace('\n', '\\n')}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of ``render``."""
    out, at = [], 0
    while at < len(formatted):
        mid = formatted.index("\n", at)
        end = formatted.index("</s>", mid)
        if not formatted.startswith("<s>", at):
            raise ValueError(f"no turn begins at {at}")
        role = _ESCAPED_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], formatted[at + 3 : mid])
        out.append((role, unescape(formatted[mid + 1 : end])))
        at = end + 4
    return out


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(which tokens lie under a span, the characters of the spans that tokens cover); both token bounds ascend."""
    mask, covered = np.zeros(len(starts), bool), []
    for s, e in spans:
        lo, hi = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))
        if s == e or lo >= hi:
            continue
        mask[lo:hi] = True
        left, right = np.maximum(starts[lo:hi], s), np.minimum(ends[lo:hi], e)
        gap = np.flatnonzero(left[1:] > np.maximum.accumulate(right)[:-1]) + 1  # tokens of one character share its span
        for x in np.split(np.arange(hi - lo), gap):
            covered.append((int(left[x[0]]), int(right[x].max())))
    return mask, covered


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Runs of rows (conv_id, role, text) of one conversation from sorted batches."""
    held, turns, any_row = None, [], False
    for b in ending(batches):
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if any_row and conv != held:
                yield held, turns
                turns = []
            held, any_row = conv, True
            turns.append((role, text))
    if any_row:
        yield held, turns


def format_chats(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, formatted, ids, loss_mask (by token), loss_starts and loss_ends (characters under the mask)."""
    c = conversations
    bound_batches(c.sparkSession)
    empty = lambda x: F.coalesce(c[x].cast("string"), F.lit("")).alias(x)
    rows = c.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), empty("role"), empty("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, out, size = _tokenizer(tokenizer_path), [], 0

        def batch() -> pa.RecordBatch:
            names = ("conv_id", "formatted", "ids", "loss_mask", "loss_starts", "loss_ends")
            kinds = (kind, pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

        for conv, turns in conversations_of(batches):
            text, spans = render(turns, loss_role)
            code = tokenizer.encode(text, add_special_tokens=False)
            at = np.array(code.offsets, np.int64).reshape(-1, 2)
            mask, covered = mask_tokens(at[:, 0], at[:, 1], spans)
            out.append((conv, text, np.array(code.ids, np.int32), mask, [s for s, _ in covered], [e for _, e in covered]))
            size += len(text)
            if size > 1 << 21:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    shape = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, ids array<int>, loss_mask array<boolean>, loss_starts array<long>, loss_ends array<long>"
    return rows.mapInArrow(run, shape)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the output holds: turns parsed from the text, and the text under the loss mask, unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ending(batches):
            out = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, shape)
