"""Token counts: the two libraries character by character, and spliced chunks against whole texts."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
HAN = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return tokens.encoder(BPE)


def test_both_libraries_agree_below_the_limit(library):
    count = tokens.counter(BPE)
    texts = [a + chr(c) + b for c in range(0x250) for a in ("a", " ", "'", "1") for b in ("b", " ", "  x")]
    assert [count(t) for t in texts] == [len(library(t)) for t in texts]


PARTS = ["a", "the", "ing", " ", "  ", "\n", "é", "梦", "東京", "カラー", "한국", "1", "½", "'s", "'", ",", "--", "_", "\u0301", "\x1c", "\u3000", "<|endoftext|>", "<|endof"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join), st.integers(4, 40), st.integers(1, 20))
def test_spliced_chunks_are_the_whole(own, library, text, chunk, overlap):
    encode, sizes, stable = own
    assert tokens.splice(encode, sizes, stable, text, max(chunk, overlap + 1), overlap).tolist() == library(text) if text else True


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=2, max_size=60).map("".join), st.randoms())
def test_proven_places_hold_in_every_part(own, library, text, rng):
    """At a proven place any part of the text that holds it is encoded as its left and its right side are."""
    _, _, stable = own
    p = stable.last(text, 0, len(text))
    if p is not None:
        for _ in range(5):
            a, b = rng.randint(0, p - 1), rng.randint(p + 1, len(text))
            if not any(s in text[max(0, a - 12) : a + 12] + "\n" + text[max(0, b - 12) : b + 12] for s in stable.special):
                assert library(text[a:b]) == library(text[a:p]) + library(text[p:b])


@pytest.mark.parametrize("text", ["".join(random.Random(1).choices(HAN, k=300_000)), "カタカナー" * 40_000, "a" * 100_000, "word " * 50_000, "\u0e01\u0e32\u0e23" * 50_000], ids=["han", "kana", "run", "words", "thai"])
def test_texts_without_spaces_take_linear_time(own, library, text):
    encode, sizes, stable = own
    began = time.perf_counter()
    ids = tokens.splice(encode, sizes, stable, text)
    took = time.perf_counter() - began
    assert ids.tolist() == library(text)
    assert took < 10, took


def test_sizes_are_the_bytes_of_ids(own):
    encode, sizes, _ = own
    for text in ("plain words", "東京 é <|endoftext|> ½"):
        assert int(np.sum(sizes[encode(text)])) == len(text.encode())


def test_other_files_are_counted_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words, twice. " * 700
    assert tokens.counter(path)(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
