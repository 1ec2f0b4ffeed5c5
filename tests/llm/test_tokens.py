"""Token counts and byte-level BPE against the libraries that define them."""

import base64
import hashlib
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import byte_bpe, token_count

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("aeistdlvrmST'  \n\t\r\x0b\x85\xa0Bé123²٣.,!—日😀́İΣ<|>"), max_size=60) | st.text(max_size=30)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=8))
def test_ids_are_the_librarys(texts, tiktoken_encoding):
    bpe = byte_bpe.load(RANKS)
    found = byte_bpe.encode_texts(bpe, texts)
    assert found == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_replay_of_long_runs(tiktoken_encoding):
    texts = ["a" * 999, "ab" * 400, "'s" * 20, " " * 50 + "x", "\n\n\n"]
    assert byte_bpe.encode_texts(byte_bpe.load(RANKS), texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT | st.just("<|endoftext|> a<|startoftext|>"), max_size=8))
def test_counts_are_the_librarys(texts, tokenizer):
    expected = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_count.load(WORDS).count(texts).tolist() == expected


def test_merges_take_the_leftmost_of_equal_ranks(tokenizer):
    words = ["a" * n for n in range(1, 40)] + ["anan" * 7, "lolololo"]
    assert token_count.load(WORDS).count(words).tolist() == [len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def test_encode_documents(spark, docs, rows, none, tiktoken_encoding):
    out = byte_bpe.encode_documents(docs.withColumnRenamed("source", "n_tokens"), RANKS, keep_ids=True)
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in out.collect())
    expected = []
    for doc_id, text, *_ in rows:
        ids = tiktoken_encoding.encode_ordinary(text or "")
        expected.append((doc_id if doc_id is not None else -1, text or "", len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), tuple(ids)))
    assert found == sorted(expected)
    assert byte_bpe.encode_documents(none, RANKS).count() == 0


def test_count_documents(docs, rows, none, tokenizer):
    out = token_count.count_tokens(docs, WORDS, limit=100)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    expected = []
    for doc_id, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id if doc_id is not None else -1, len((text or "").encode()), n, n > 100))
    assert found == sorted(expected)
    assert token_count.count_tokens(none, WORDS).count() == 0


def test_decode_gives_the_bytes_back():
    bpe = byte_bpe.load(RANKS)
    from graphloom.llm import arrays

    data, offsets = arrays.buffer(pa.array(["héllo  wörld\n", None, "x"]))
    ids, _ = bpe.encode(data, offsets)
    assert bpe.decode(ids).tobytes() == "héllo  wörld\nx".encode()
