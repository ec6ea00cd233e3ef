"""Encoding against the public library, and back to the text."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratamap.llm import encode
from stratamap.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encode.read_ranks(PATH), special_tokens={})


def ours(texts, merge=None):
    ids, n, _ = encode.encode_texts(pa.array(texts, pa.string()), merge or encode.merger(PATH))
    o = np.append(0, np.cumsum(n))
    return [ids[a:b].tolist() for a, b in zip(o[:-1], o[1:])]


alphabet = st.sampled_from(list("  '''\n\t \x0b\x85\xa0　aàsdtrevlmLLSaé́.,!?-_12½Ⅷ٣​日本語🎉👨‍👩‍👧xß\r\0\x1c{}\\$%<|endoftext|>"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(alphabet, max_size=40).map("".join), max_size=6))
def test_against_the_public_library(public, texts):
    assert ours(texts) == [public.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_any_text_and_back(public, text):
    (ids,) = ours([text])
    assert ids == public.encode_ordinary(text) and encode.decode(ids, encode.read_ranks(PATH)) == text


def test_very_long_pieces_and_ties(public):
    texts = ["a" * 3000, "ab" * 2000, "'ll" * 700, " " * 5000 + "x", "=" * 4001, "", "é" * 1500, "don't we'll you've 'tis 'Sx"]
    assert ours(texts) == [public.encode_ordinary(t) for t in texts]


def test_a_small_cache_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(encode, "CACHE", 3)
    merge = encode.Merger(encode.read_ranks(PATH))
    for t in ("one two three four five", "six seven one two", "one two three four five"):
        assert ours([t], merge) == [public.encode_ordinary(t)]


def test_slices_of_an_array(public):
    texts = pa.array(["skip", None, "don't", "", "two words"], pa.string()).slice(1, 4)
    ids, n, ends = encode.encode_texts(texts, encode.merger(PATH))
    assert n.tolist() == [0, len(public.encode_ordinary("don't")), 0, len(public.encode_ordinary("two words"))]
    assert ends.tolist() == [3, 5, 3, 9]


def test_documents(spark, public, monkeypatch):
    rows = [(1, "Hello, world"), (1, "again"), (2, None), (3, ""), (None, "x"), (4, "word " * 30000)]
    d = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode.encode_corpus(d, PATH).collect()), key=str)
    assert got == sorted(((k, public.encode_ordinary(t) if t else []) for k, t in rows), key=str)
    assert encode.encode_corpus(d.limit(0), PATH).count() == 0
    ranks = encode.read_ranks(PATH)
    for r in encode.encode_corpus(d, PATH, offsets=True).filter("size(ids) < 100").collect():
        text = next(t for k, t in rows if k == r.doc_id and public.encode_ordinary(t or "") == list(r.ids)) or ""
        assert encode.decode(r.ids, ranks) == text and len(r.ends) == len(r.ids) and (not text or r.ends[-1] == len(text.encode()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 * encode.SYMBOLS - 1), max_size=400))
def test_scan_of_transition_functions(symbols):
    nexts, starts, function, compose, values = encode.automaton()
    got, state = encode._exclusive(function[np.array(symbols, np.int64)]), encode.START
    for f, x in zip(got, symbols):
        assert values[f, encode.START] == state
        state = nexts[state, x]
