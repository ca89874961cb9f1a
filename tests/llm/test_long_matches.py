"""Long matches of the tokenizer's pattern, against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chronoward.llm import bpe


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    codec, library = both
    return codec.encode([text])[0] == np.array(library.encode(text, disallowed_special=()), dtype="<u4").tobytes()


def test_every_match_by_the_long_recursion(both, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 1)
    both[0].cache.clear()
    rng = random.Random(5)
    for letters in ("ab", "eta", "abcdefghijklmnopqrstuvwxyz", "éßжщ中文的是不了", "=-", "0123456789"):
        for n in (1, 2, 3, 5, 17, 60, 400):
            assert same(both, "".join(rng.choice(letters) for _ in range(n)))
            assert same(both, letters * n)
    both[0].cache.clear()


def test_long_repeats(both):
    assert all(same(both, t) for t in ("a" * 100_001, "ab" * 40_000, "=" * 60_000, "information" * 5_000))


def test_long_match_without_repeats(both):
    rng = random.Random(6)
    assert same(both, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(13_000)))
