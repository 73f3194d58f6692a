"""Word encoder, token files and packing against the tokenizers library and brute force."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from foldstat.llm.packing import pack, plan
from foldstat.llm.token_files import TokenFiles, read_token_files, write_token_files
from foldstat.llm.word_encoder import WordEncoder

from .conftest import SF

WORDS = P.path("word_bpe_49k.json")
ODD = ["", " ", "a", "İstanbul ΣΑΣ naïve café", "<|endoftext|> x", "a <|endoftext|> b", "A<|startoftext|>B<|endoftext|>&&& <|ENDOFTEXT|> <|endoftext |>", "H̱ A\u030a \u0301a É Ÿ ÿ ß \u0130 \u1e9e", "Ab,Cd ab, AB; É. é! <x> a<b", "can't DON'T 'sss \"'t x1y22", "tab\there\x1cfs em nb", "日本語 text 🎉🎉 !!??", "ǅ ﬁ Ⅷ ² ½", "a" * 5000, "...", "́́ x", "x\r\ny\x85z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def brute(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library(library):
    texts = ODD + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    ids, offsets = WordEncoder(WORDS).encode(texts, 1)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == brute(library, text, 1), text[:80]


def test_encoder_forgets_without_change(monkeypatch, library):
    import foldstat.llm.word_encoder as m

    monkeypatch.setattr(m, "MEMO", 5)
    e = WordEncoder(WORDS)
    for _ in range(3):
        ids, offsets = e.encode(["one two three four five six seven", "eight nine"])
        assert ids[offsets[1] :].tolist() == library.encode("eight nine", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(500, None), (501, ""), (502, "x " * 3000), (502, "x " * 3000), (None, "lost")]
    frame = spark.createDataFrame([(a, b, "n", 3) for a, b in rows], "doc_id long, text string, n_tokens string, start int").repartition(3)
    uri = str(tmp_path / "files")
    manifest = write_token_files(frame, uri, WORDS)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in read_token_files(spark, uri).collect())
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        ids = brute(library, text, 1)
        want.append((at, doc, len(ids), crc(ids), tuple(ids)))
        at += len(ids)
    assert got == want
    assert manifest["ids"] == at
    files = TokenFiles(uri)
    assert len(files) == len(rows)
    assert files.document(0)[0] is None
    assert files.document(3)[1].tolist() == list(want[3][4])
    everything = [i for w in want for i in w[4]]
    assert files.ids(0, at).tolist() == everything
    assert files.ids(at // 3, at // 3 + 5000).tolist() == everything[at // 3 : at // 3 + 5000]


def test_token_files_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(empty, str(tmp_path / "e"), WORDS)
    assert read_token_files(spark, str(tmp_path / "e")).collect() == []


def check_plan(counts, capacity):
    rows = plan(counts, capacity)
    got, bins = {}, {}
    for length, first, n, seq, each, place in rows.tolist():
        assert first == got.get(length, 0)
        got[length] = first + n
        for i in range(n):
            bins.setdefault(seq + i // each, []).append((place + i % each * length, length))
    assert got == {k: v for k, v in counts.items() if v}
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for place, length in sorted(own):
            assert place == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in own) <= 2
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60)) if seed % 2 else 2048
    sizes = rng.integers(1, capacity + 1, rng.integers(0, 400)) if seed % 3 else np.clip(rng.lognormal(3, 1.5, 500).astype(int), 1, capacity)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    n = check_plan(counts, capacity)
    bins = []  # best fit, longest first, one by one
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [g for g in bins if g >= s]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - s)
        else:
            bins.append(capacity - s)
    assert n <= len(bins) * 1.03 + 1


def test_plan_large_classes():
    assert check_plan({1: 5}, 1) == 5
    assert check_plan({2048: 3, 1024: 5, 1: 2048}, 2048) == 7
    assert check_plan({}, 2048) == 0


def test_pack_against_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(500, None), (501, ""), (502, "x " * 3000), (503, "x " * 4095), (None, "lost"), (None, "lost")]
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, length int").repartition(5)
    out = pack(frame, WORDS).collect()
    want = sorted(
        (-1 if d is None else d, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048]), tuple(ids[s : s + 2048]))
        for d, t in rows for ids in [brute(library, t, 0)] for k, s in enumerate(range(0, len(ids), 2048))
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 2048) * 1.02 + 1
    assert pack(frame.limit(0), WORDS, ids=False).collect() == []
