"""Pieces: ids and decoded texts must be the library's own, and survive a small table."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from paneloom.llm.pieces import Chunks, encode_texts, packed, read_model
from paneloom.llm.queries import digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = Chunks(read_model(PATH))
SCHEMA = "doc_id long, text string, ids string, decoded int"

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "  a  b ", "x\n\ty", "▁", "a▁b", "▁▁ ▁", "<s>a</s>", "\x00a\x00 b",
    "😀😀 日本語 テスト", "naïve café", "　x", "ﬁ", "a" * 3000, " " * 40 + "end", "﻿", "\r\n\r\n", "é",
]


def expected(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    return packed(ids), LIBRARY.decode(ids)


def test_model_can_be_cut_into_chunks():
    assert OWN.chunkable() and not OWN.whole


def test_fixed_texts():
    assert OWN.encode(TEXTS) == [expected(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\ta<>s/"), st.characters(exclude_categories=["Cs"])))))
def test_any_text(texts):
    assert OWN.encode(texts) == [expected(t) for t in texts]


def test_small_table():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 90) for _ in range(30)) for _ in range(50)]
    small = Chunks(read_model(PATH), kept=40)
    assert [small.encode([t])[0] for t in texts] == [expected(t) for t in texts]
    assert len(small.table) <= 40


def test_query_rows(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, None), (3, None), (4, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    want = []
    for i, text in rows:
        ids, decoded = expected(text or "")
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = digests(encode_texts(docs, read_model(PATH)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert digests(encode_texts(docs.limit(0), read_model(PATH))).count() == 0
