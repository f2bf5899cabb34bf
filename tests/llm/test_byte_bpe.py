"""Byte-level BPE against the library, on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from dayroll.llm import byte_bpe
from dayroll.llm import queries as llm
from dayroll.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n  \t", "a", "Hello  world's <|endoftext|> tests", "日本語🙂 é́ ﬁ", "x" * 30_000, "ab c " * 8_000, "a\x00b\r\n", "!!!???***", "thé end　"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS), special_tokens={})


def test_ids_and_decoded_bytes_are_the_library_s(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 20_000)  # so that texts fall into several blocks
    rows = [*enumerate(ODD), (None, "no id"), (4, "a"), (4, "a")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, ids int, block string, decoded int").repartition(3)
    got = byte_bpe.decode_bytes(byte_bpe.encode_bytes(docs, RANKS, PATTERN), RANKS).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    for r in got:
        text = (ODD[r.doc_id] if r.doc_id is not None else "no id") or ""
        assert r.ids == library.encode_ordinary(text), text[:20]
        assert bytes(r.decoded) == library.decode_bytes(r.ids) == text.encode()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_bytes(none, RANKS, PATTERN).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.ids) for r in byte_bpe.encode_bytes(only, RANKS, PATTERN).collect()) == [(1, []), (2, [])]


def test_equal_pre_tokens_of_all_blocks_are_encoded_once(spark, monkeypatch):
    seen = []

    class Counting(byte_bpe.ByteEncoder):
        def ids(self, word):
            seen.append(word)
            return super().ids(word)

    counting = Counting(byte_bpe.ranks(RANKS))
    monkeypatch.setattr(byte_bpe, "encoder", lambda path: counting)
    blocks = [byte_bpe.pack_words(pa.array([b"alike", b" words", own], pa.large_binary())) for own in (b"one", b"two", b"one")]
    group = pa.table({"block": [7, 8, 9], "bucket": pa.array([0, 0, 0], pa.int32()), "a": [a for a, _ in blocks], "b": [b for _, b in blocks]})
    taken = {}

    class Rows:
        def select(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, schema):
            taken["out"] = f(group)

    byte_bpe._encoded(Rows(), RANKS)
    assert sorted(seen) == sorted({b"alike", b" words", b"one", b"two"})
    out = taken["out"].to_pylist()
    assert [byte_bpe.unpack(r["ids"]).tolist() for r in out] == [[i for w in (b"alike", b" words", own) for i in counting.ids(w)] for own in (b"one", b"two", b"one")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_packed_numbers_come_back(x):
    assert byte_bpe.unpack(byte_bpe.pack(np.array(x, np.int64))).tolist() == x


def test_decoding_refuses_unknown_ids(spark):
    assert byte_bpe.decode_bytes(spark.createDataFrame([(None,), ([],)], "ids array<int>"), RANKS).orderBy("ids").collect()[0].decoded is None
    for wrong in ([50_300], [-1], [1, None]):
        with pytest.raises(Exception, match="token-byte table"):
            byte_bpe.decode_bytes(spark.createDataFrame([(wrong,)], "ids array<int>"), RANKS).collect()
    with pytest.raises(ValueError, match="no token for the bytes"):
        byte_bpe.ByteEncoder({b"a": 0})


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in table(spark, sf, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in llm.op12_byte_bpe(spark, sf).collect()} == want
