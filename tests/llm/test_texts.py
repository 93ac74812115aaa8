"""Text scanning and byte pairs against plain Python and the tokenizer library."""

import re

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clientele.llm import textscan
from clientele.llm.bpe import byte_pairs
from tests.llm.data import TOKENIZER, prose

LIBRARY = Tokenizer.from_file(TOKENIZER)
SIGNS = st.text(alphabet="aBé ñZ01'srtvelmd\n\t\x0b\xa0　.,!—中ªⅫ\x1c\x85\u200b\U0001F600<|>endoftext", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(SIGNS, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    words, first = textscan.word_hashes(textscan.utf8(texts), lower=True)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lower]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    known = {}
    for h, w in zip(words.tolist(), sum(plain, []), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(SIGNS, st.just("<|endoftext|>"), st.just("a<|endoftext|>'ll")), max_size=8))
def test_ids_are_those_of_the_library(texts):
    LIBRARY.encode_special_tokens = False
    expected = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in byte_pairs(TOKENIZER).encode(texts)] == expected
    LIBRARY.encode_special_tokens = True
    expected = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in byte_pairs(TOKENIZER, ordinary=True).encode(texts)] == expected


def test_long_texts_are_scanned_in_pieces():
    text = prose(5, 200_000)
    words, _ = textscan.word_hashes([text.encode()])
    again, _ = textscan.word_hashes([("x " + text).encode()])
    assert len(words) == 200_000 and np.array_equal(words, again[1:])


def test_shingles_of_short_texts():
    words, _ = textscan.word_hashes([b"a b c"])
    assert len(textscan.shingle_hashes(words, 4)) == 1 and len(textscan.shingle_hashes(words[:0], 4)) == 0
