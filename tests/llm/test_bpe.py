import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from scriptorium.llm.bpe import Codec, decode_documents, default_vocabulary, encode_documents, read_ranks  # noqa: E402

RANKS = read_ranks(default_vocabulary())
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
TINY = Codec(RANKS, P.PATTERN, leaf=3, piece_leaf=1)
USUAL = Codec(RANKS, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aabcdehiot  \n\t\r'’strelvm.,!0129 ßé日")), st.characters(codec="utf-8")), max_size=80))
def test_tree_equals_the_library(text):
    want = ORACLE.encode_ordinary(text)
    assert TINY.encode(text) == want
    assert USUAL.encode(text) == want
    assert USUAL.decode(want) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'lverstdm 1\n日é,!")), min_size=200, max_size=1500))
def test_usual_leaves_equal_the_library(text):
    assert USUAL.encode(text) == ORACLE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=700))
def test_both_ways_to_merge(piece):
    rank_only = Codec(RANKS, P.PATTERN)
    whole = rank_only.ranks.get(piece)
    assert rank_only.merge_waiting(piece) == ([whole] if whole is not None else rank_only.merge(piece))
    assert rank_only.merge_waiting(piece) == ORACLE._core_bpe.encode_single_piece(piece)


def test_all_documents():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        assert USUAL.encode(text or "") == ORACLE.encode_ordinary(text or "")


def test_no_library_in_the_operator():
    import inspect

    from scriptorium.llm import bpe

    assert "tiktoken." not in inspect.getsource(bpe).replace("byte_bpe_50k.tiktoken", "") and "import tiktoken" not in inspect.getsource(bpe)


@pytest.mark.parametrize("text", ["中文字符" * 5000, "中文，字。" * 4000, "'l" * 3000 + "'ll", "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 900, "a" * 20_001, "ab" * 6000 + "c", " " * 9000 + "x", "\n" * 5001, "!?" * 5000, "é" * 9999, "the quick  fox's " * 3000])
def test_long_texts(text):
    assert USUAL.encode(text) == ORACLE.encode_ordinary(text)


def test_documents(spark):
    texts = [(1, "Hello  world's end"), (2, None), (3, ""), (3, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, n_tokens string")
    rows = encode_documents(df, want=("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == 5
    for r, (_, t) in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(texts, key=lambda x: str(x[0])), strict=True):
        want = ORACLE.encode_ordinary(t or "")
        assert (r["n_tokens"], r["ids"]) == (len(want), want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = decode_documents(encode_documents(df)).collect()
    assert sorted(str(r["text"]) for r in back) == sorted((t or "") for _, t in texts)
    assert encode_documents(df.limit(0)).count() == 0


SMALL = Codec(RANKS, P.PATTERN, leaf=40, piece_leaf=7)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab=-h")), min_size=1, max_size=9), st.integers(1, 400), st.text(alphabet=st.sampled_from(list("ab=- é")), max_size=5))
def test_repeated_parts(part, times, rest):
    text = rest + part * times + rest
    want = ORACLE.encode_ordinary(text)
    assert SMALL.encode(text) == want
    assert TINY.encode(text) == want
    assert USUAL.encode(text) == want


@pytest.mark.parametrize("part", ["=", "ha", "=-", "a", "aab"])
def test_a_million_characters_in_one_piece(part):
    import time

    text = "x " + part * (1_000_000 // len(part)) + " y"
    began = time.process_time()
    found = USUAL.encode(text)
    assert time.process_time() - began < 5
    assert found == ORACLE.encode_ordinary(text)


def test_a_run_that_the_library_can_not_match():
    found = USUAL.encode(" " * 1_000_000)  # a token of one space at a time
    assert USUAL.decode(found) == b" " * 1_000_000
    assert found[-2000:] == ORACLE.encode_ordinary(" " * 5000)[-2000:]
