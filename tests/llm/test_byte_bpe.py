import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import awkward, empty, with_clashes

from rankloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encode(texts):
    return list(byte_bpe.codec(PATH).encode(texts))


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " \n a", "don't 've'll 's", "'s's't", "a'", "''s", " 's", "\n's", "I'LL we're", "x  y   z ", "12 345٣²", "a\x00b", "\x1c\x1d a", "é 漢字 🙂!?", "<|endoftext|>", "\u3000\u00a0\u2028x", "a" * 5000, " " * 5000])
def test_as_the_library(text):
    assert encode([text]) == [LIBRARY.encode_ordinary(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abst'remvldLÉß \n\t\r\x0b12٣!?.-\u2019\u3000\u00a0漢🙂\x00\x1c\x85"), max_size=40), max_size=8))
def test_batches_as_the_library(texts):
    found = encode(texts)
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [byte_bpe.codec(PATH).decode(i) for i in found] == [t.encode() for t in texts]


def test_every_code_point_has_its_class():
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for end in ("'s", "'ll go", "1 a"):
        texts = ["\n".join(c + end for c in points[i : i + 5000]) for i in range(0, len(points), 5000)]
        assert encode(texts) == LIBRARY.encode_ordinary_batch(texts)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=300) | st.text(min_size=1, max_size=80).map(lambda t: t.encode("utf-8", "replace")))
def test_merging_as_the_library(data):
    assert byte_bpe.merged(data, RANKS) == LIBRARY._encode_single_piece(data)


def test_merging_of_a_very_long_slice():
    text = "ab" * 50_000 + "x" * 50_000
    assert byte_bpe.merged(text.encode(), RANKS) == LIBRARY.encode_ordinary(text)


def test_offsets_decode_any_span():
    codec, text = byte_bpe.codec(PATH), "Token offsets — décodage 漢字 🙂 of any span."
    ids = encode([text])[0]
    at = codec.offsets(ids)
    assert at[-1] == len(text.encode())
    for i in range(len(ids)):
        for j in range(i, len(ids) + 1):
            assert codec.decode(ids[i:j]) == codec.decode(ids[i:j], at[i : j + 1]) == text.encode()[at[i] : at[j]]


def test_the_scan_composes_in_any_order():
    _, _, compose, _, _, _ = byte_bpe._machine()
    n = len(compose)
    a, b, c = np.indices((n, n, n))
    assert (compose[compose[a, b], c] == compose[a, compose[b, c]]).all()


def test_frames(spark):
    docs = awkward(spark)
    found = byte_bpe.round_trip(with_clashes(docs), PATH).collect()
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    encoded = byte_bpe.encoded(docs, PATH)
    back = byte_bpe.decoded(encoded, PATH).collect()
    assert sorted(repr((r["doc_id"], bytes(r["data"]).decode())) for r in back) == sorted(repr((r["doc_id"], r["text"] or "")) for r in docs.collect())
    assert byte_bpe.round_trip(empty(spark), PATH).count() == 0
    assert all(r["offsets"] == byte_bpe.codec(PATH).offsets(r["ids"])[:-1].tolist() for r in encoded.collect())


def test_counts_under_several_vocabularies(spark):
    docs = awkward(spark)
    paths = {"one": PATH, "many": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    libraries = {k: tiktoken.Encoding(k, pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(p), special_tokens={}) for k, p in paths.items()}
    found = byte_bpe.counted(with_clashes(docs), paths).collect()
    want = [(r["doc_id"], *(len(e.encode_ordinary(r["text"] or "")) for e in libraries.values())) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert byte_bpe.counted(empty(spark), paths).count() == 0
