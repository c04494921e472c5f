"""Words of the token files: the library's split, found for many texts at once, and what a worker remembers of them."""

import random
from collections import Counter

import numpy as np
import pytest

from runledger.llm import bpe, queries, token_pack

PIECES = [" ", "  ", "\n", "\t", " \n", "\n ", "a", "bc", "é", "Ñu", "s", "t", "re", "ve", "ll", "l", "v", "'", "''", "m", "d", "1", "23", "!", "?-", "'s", "'re", "'LL", "\x1c", "\x00", "\x7f"]


@pytest.fixture
def memory():
    return token_pack._Memory(queries.tokenizer_path())


def library(memory, text):
    return [*memory.coder.lib.encode(text, add_special_tokens=False).ids, token_pack.END_ID]


def ids_of(memory, texts):
    lens, ids = memory.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]


def test_words_are_those_of_the_library(memory):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(20_000)]
    data = np.frombuffer(b"".join(t.encode() + bytes([token_pack.END]) for t in texts), np.uint8)
    starts = np.flatnonzero(token_pack.starts_of_words(data))
    got = [data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    split = memory.coder.lib.pre_tokenizer.pre_tokenize_str
    want = [w for t in texts for w in [*(t[a:b].encode() for _, (a, b) in split(t)), bytes([token_pack.END])]]
    assert got == want


def test_texts_of_both_ways_side_by_side(memory):
    rng = random.Random(4)
    pieces = [*PIECES, "日本", "×", "÷", "½", "\u00a0", "’s", "<|endoftext|>", "<|endof", "�", "🙂"]
    texts = ["", *("".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(3000)), "", "<|endoftext|>", "'", "'s", "日本"]
    assert ids_of(memory, [t.encode() for t in texts]) == [library(memory, t) for t in texts]
    ill = [b"a\xff b", b"\xff", b"caf\xc3", b"\xed\xa0\x80 x", b"it's \xc3\x28"]
    assert ids_of(memory, ill) == [library(memory, t.decode("utf-8", "replace")) for t in ill]


def test_a_full_memory_keeps_the_words_that_come_again(memory, monkeypatch):
    monkeypatch.setattr(token_pack, "REMEMBERED", 40)
    encoded, encode = Counter(), bpe.Coder.encode
    monkeypatch.setattr(bpe.Coder, "encode", lambda self, words: encoded.update(words) or encode(self, words))
    for n in range(12):
        texts = [f"the {n}x quick" + "".join(f" w{chr(97 + n)}{chr(97 + i)}" for i in range(25))] * 3
        assert ids_of(memory, [t.encode() for t in texts]) == [library(memory, t) for t in texts]
        assert len(memory.seen) <= 40 + 30
    assert encoded["the"] == encoded[" quick"] == 1


def test_a_memory_full_of_words_that_come_again_stays_bounded(memory, monkeypatch):
    monkeypatch.setattr(token_pack, "REMEMBERED", 40)
    words = [f" {chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    for _ in range(4):
        for at in range(0, len(words), 20):
            text = "".join(words[at : at + 20])
            assert ids_of(memory, [text.encode()] * 2) == [library(memory, text)] * 2
            assert len(memory.seen) <= 40 + 21
