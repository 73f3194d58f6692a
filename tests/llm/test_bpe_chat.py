"""Byte BPE against tiktoken, chat formatting as an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from foldstat.llm import byte_bpe, chat

from .conftest import SF

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\n\ny  z \t", "can't we'll 'S", "日本語 テキスト", "🎉🎉 ok", "a" * 700, "ab" * 300, "x\x1c y \x85z b", "12345 67 8.9", "<|endoftext|>", "é́ naïve ﬁ"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.byte_encoder(RANKS, P.PATTERN)


def test_every_token_is_its_own_encoding_or_whole(encoder):
    v = encoder.vocabulary
    rng = random.Random(1)
    for t in rng.sample(sorted(v.ranks), 3000):
        assert encoder.encode([t.decode("utf-8", "ignore")])[0] is not None


def test_equals_tiktoken(encoder, library, spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids, offsets = encoder.encode(texts)
    raw, ends = encoder.decode(ids, offsets)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode_ordinary(text), text[:60]
        assert raw[ends[i] : ends[i + 1]].tobytes() == text.encode()


def test_random_bytes_and_letters(encoder, library):
    rng = random.Random(7)
    for alphabet in ("abcdeinorst", "éèaeßüö", "あい語", "ab \n'", "01 .-"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_append_and_edit_are_exact(encoder):
    v = encoder.vocabulary
    rng = random.Random(3)
    for _ in range(60):
        data = "".join(rng.choice("aeinorstthe ") for _ in range(rng.randrange(1, 900))).encode()
        table = byte_bpe.PrefixTable(v, data[:10])
        for at in range(10, len(data), 37):
            table.append(data[at : at + 37])
        assert table.last == byte_bpe.PrefixTable(v, data).last
        s = rng.randrange(len(data) + 1)
        e = min(len(data), s + rng.randrange(8))
        new = bytes(rng.choice(b"xyzthe") for _ in range(rng.randrange(8)))
        worked = table.replace(s, e, new)
        fresh = byte_bpe.PrefixTable(v, data[:s] + new + data[e:])
        assert (table.data, table.last) == (fresh.data, fresh.last)
        assert worked <= len(fresh.data) - s
        assert table.ids() == v.merged(table.data)


def test_memo_is_only_speed(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    e = byte_bpe.ByteEncoder(byte_bpe.read_ranks(RANKS), P.PATTERN)
    for _ in range(3):
        assert e.encode(["one two three four five", "six"])[0].tolist() == library.encode_ordinary("one two three four five") + library.encode_ordinary("six")


def test_frame(spark, library):
    rows = [(1, None), (2, ""), (3, "two  words"), (3, "two  words"), (None, "x")]
    frame = spark.createDataFrame([(a, b, "?") for a, b in rows], "doc_id long, text string, ids string")
    out = byte_bpe.encode(frame, RANKS, P.PATTERN, decoded=True)
    got = sorted(((r.doc_id or 0), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted((a or 0, len(i), np.array(i, "<u4").tobytes(), (b or "").encode()) for a, b in rows for i in [library.encode_ordinary(b or "")])
    again = byte_bpe.decode(out, RANKS, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((b or "").encode() for _, b in rows)
    assert byte_bpe.encode(frame.limit(0), RANKS, P.PATTERN).collect() == []


CHATS = [
    (1, 0, "user", "hi </s> there"), (1, 1, "assistant", "\\ <s>\\</s>[INST][/INST] \\\\"), (1, 2, "assistant", ""), (1, 3, "assistant", "日本🎉"),
    (2, 5, "assistant", "late"), (2, None, "sys\ntem\\n<s>", "null turn"), (2, 1, None, None), (3, 0, "user", None),
    (None, 0, "assistant", "no id"), (None, 1, "user", "no id"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long " * 20000),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*c, 1) for c in CHATS], "conv_id long, turn int, role string, text string, formatted int").repartition(4)
    made = chat.format_chats(frame, P.path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in made.collect()}
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {c[0] for c in CHATS}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((c for c in CHATS if c[0] == conv), key=lambda c: (-1 if c[1] is None else c[1], c[2] or "", c[3] or ""))]
        row = got[conv]
        assert chat.parse(row.formatted) == turns
        assert len(row.ids) == len(row.loss_mask)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (back[conv].n_turns, back[conv].loss_chars, back[conv].loss_sha256) == (len(turns), len(loss), sha(loss))
        assert back[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert back[conv].formatted_chars == len(row.formatted)
        assert any(row.loss_mask) == bool(loss)
    assert chat.read_back(chat.format_chats(frame.limit(0), P.path("byte_bpe_50k.json"))).collect() == []


def test_escape_is_reversible():
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "s>", "[", "I", "n", "\n", "\\s", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        made = chat.escape(text)
        assert chat.unescape(made) == text
        assert not any(c in made for c in chat.CONTROL)
        assert chat.parse(chat.render([(text, text), ("assistant", text)])[0]) == [(text, text), ("assistant", text)]
