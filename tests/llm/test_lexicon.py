"""BPE with a compiled lexicon: ids and decoded texts must be the library's own, whatever the lexicon holds."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paneloom.llm.lexicon import Encoder, Lexicon, bpe_encode, compile_lexicon, frequent_words, lexicon_of, read_tokenizer
from paneloom.llm.queries import digests

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXT = read_tokenizer(PATH)
EMPTY = Encoder(TEXT)
OWN = Encoder(TEXT, lexicon_of(EMPTY, ["the", "hello", "don't", "é", "日本", "!!", "word", "words", "<", "|", "end"]))

TEXTS = [
    "", " ", "a", "Hello the WORLD words word", "x\n\ty", "don't we'll I'M 've", "123 4५", "<|startoftext|>a<|endoftext|>",
    "a<|endoftext|>b <|EndOfText|> <|endoftext", "é é É ́x", "😀😀 日本語 テスト", "naïve CAFÉ Straße ΣΑΣ ΟΔΟΣ", "x　y\xa0z\x85w v",
    "\x1c\x1d\x1e\x1f a\x1cb", "\x00a\x00 \x00", "a" * 3000, " " * 40 + "end", "﻿a", "\r\n\r\n", "!!!???", "İI ﬁ ​᠎", "  ",
    " a b c", "ᾳ̈ ͅα", "क़ Å Ω",
]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


def test_is_cuttable():
    assert not EMPTY.whole and not OWN.whole
    assert Encoder(read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))).whole


@pytest.mark.parametrize("encoder", [EMPTY, OWN])
def test_fixed_texts(encoder):
    for t in TEXTS:
        assert encoder.encode([t])[0] == expected(t), t
    assert encoder.encode(TEXTS) == [expected(t) for t in TEXTS]


ALPHABET = st.one_of(st.sampled_from(" \n\tabestrEST'<|>1!é́\xa0"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET)))
def test_any_text(texts):
    assert OWN.encode(texts) == [expected(t) for t in texts]


def test_every_space_like_code_point():
    texts = [f"a{chr(c)}B" for c in range(0x10000) if chr(c).isspace() or not chr(c).isprintable() and not 0xD800 <= c < 0xE000 and c < 0x3100]
    assert EMPTY.encode(texts) == [expected(t) for t in texts]


def test_automaton_numbers_words_and_shares_suffixes():
    rng = random.Random(1)
    words = {"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 9))).encode() for _ in range(400)}
    order = sorted(words)
    found = Lexicon(compile_lexicon((w, [i, i + 1][: 1 + i % 2]) for i, w in enumerate(order)))
    others = [w + b"x" for w in order] + [b"", b"z", b"a" * 300]
    others = [w for w in others if w not in words]
    assert found.numbers(order + others).tolist() == list(range(len(order))) + [-1] * len(others)
    assert [found.ids_of(i) for i in range(len(order))] == [[i, i + 1][: 1 + i % 2] for i in range(len(order))]
    # Four beginnings with the same three endings: five states, root included, where a tree needs 17.
    small = Lexicon(compile_lexicon((a + b, [1]) for a in (b"p", b"q", b"r", b"s") for b in (b"ing", b"ion", b"it")))
    assert len(small.accepts) < 8


def test_unseen_words_are_merged_exactly():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + ["in" * 5000]
    assert OWN.encode(words) == [expected(w) for w in words]


def test_small_table():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefé日") * rng.randint(1, 90) for _ in range(30)) for _ in range(50)]
    small = Encoder(TEXT, kept=40)
    assert [small.encode([t])[0] for t in texts] == [expected(t) for t in texts]
    assert len(small.ids_table) <= 40 and len(small.text_table) <= 40


def test_frequent_words(spark):
    docs = spark.createDataFrame([("B a, b a b",), ("c",), (None,), ("",)], "text string")
    assert frequent_words(docs) == ["a", "b"] and frequent_words(docs, most=1) == ["b"]
    assert frequent_words(docs, most=0) == []


def test_query_rows(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, None), (3, None), (4, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, decoded int")
    want = []
    for i, text in rows:
        ids, decoded = expected(text or "")
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = digests(bpe_encode(docs, TEXT))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert digests(bpe_encode(docs.limit(0), TEXT)).count() == 0
