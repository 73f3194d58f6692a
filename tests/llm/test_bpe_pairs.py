"""Which two tokens may stand side by side, without merging their bytes anew."""

import random

import public_tokenizers
from foldstat.llm import byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_stable_pairs_against_plain_merges():
    v, rng = byte_bpe.Vocabulary(RANKS), random.Random(3)
    ids = list(v.bytes_of)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    for token in rng.sample(ids, 1500):
        data = v.bytes_of[token] + v.bytes_of[rng.choice(ids)]
        for cut in range(1, len(data)):
            for end in range(cut + 1, len(data) + 1):
                if data[:cut] in RANKS and data[cut:end] in RANKS:
                    pairs.append((RANKS[data[:cut]], RANKS[data[cut:end]]))
    want = [v.merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b] for a, b in pairs]
    assert [v.pairs[p] for p in pairs] == want and 1000 < sum(want) < len(want) - 1000


def test_repeated_bytes_and_small_vocabularies():
    rng = random.Random(4)
    for _ in range(60):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 14:  # each token merges two encodings, as training makes them
            v = byte_bpe.Vocabulary(ranks)
            both = rng.choice(list(ranks)) + rng.choice(list(ranks))
            if both not in ranks and len(v.merged(both)) == 2:
                ranks[both] = len(ranks)
        v = byte_bpe.Vocabulary(ranks)
        for _ in range(60):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert v.encoded(data) == byte_bpe.PrefixTable(v, data).ids() == v.merged(data)


def test_bytes_are_merged_once_for_each_token(monkeypatch):
    calls = []
    monkeypatch.setattr(byte_bpe.Vocabulary, "merged", lambda self, data, f=byte_bpe.Vocabulary.merged: calls.append(data) or f(self, data))
    v, rng = byte_bpe.Vocabulary(RANKS), random.Random(5)
    letters = [t for t in RANKS if t.isalpha() and len(t) < 5]
    for _ in range(3000):
        v.encoded(b"".join(rng.choice(letters) for _ in range(5)))
    assert len(calls) == len(set(calls)) and all(d in RANKS for d in calls)
