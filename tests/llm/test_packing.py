import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import awkward, documents, empty, with_clashes
from tokenizers import Tokenizer

from rankloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def valid(plan, counts, capacity):
    used = Counter()
    for times, need in plan:
        assert times > 0 and sum(length * n for length, n in need.items()) <= capacity
        for length, n in need.items():
            used[length] += times * n
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(times for times, _ in plan)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40))
def test_plans_use_every_piece_once(counts):
    sequences = valid(packing.packing_plan(counts, 64), counts, 64)
    assert sequences >= -(-sum(k * v for k, v in counts.items()) // 64)


@pytest.mark.parametrize(
    "counts,sequences",
    [({}, 0), ({2048: 7}, 7), ({1000: 5, 1048: 5}, 5), ({1000: 4, 600: 4, 448: 4}, 4), ({1000: 2, 500: 2, 300: 2, 248: 2}, 2), ({1: 4096}, 2), ({1025: 10}, 10), ({683: 9, 682: 3, 1365: 5}, 8)],
)
def test_exact_complements(counts, sequences):
    assert valid(packing.packing_plan(counts, 2048), counts, 2048) == sequences


def test_plan_is_bounded_by_the_capacity():
    rng = np.random.default_rng(1)
    counts = {n: int(rng.integers(1, 10**9)) for n in range(1, 2049)}
    plan = packing.packing_plan(counts, 2048)
    # no two pieces of more than half the capacity go together
    least = max(-(-sum(k * v for k, v in counts.items()) // 2048), sum(v for k, v in counts.items() if k > 1024))
    assert valid(plan, counts, 2048) <= least * 1.02
    assert len(plan) < 4 * 2048


def check(docs, found, capacity):
    want = []
    for r in docs.collect():
        ids = np.array([*TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids) + 1, capacity)], strict=False)):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = found.collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_awkward_rows(spark):
    docs = awkward(spark)
    check(docs, packing.pack_documents(with_clashes(docs), PATH, 2048), 2048)
    assert packing.pack_documents(empty(spark), PATH, 2048).count() == 0


def test_small_sequences_and_hot_lengths(spark):
    docs = documents(spark, ["same text again"] * 500 + ["a b c d e f g h i j k l m n o p", None, "<|endoftext|> is a token", "so is<|endoftext|><|endoftext|>this one's"])
    total = sum(r["length"] for r in packing.token_pieces(docs, PATH, 16).collect())
    assert check(docs, packing.pack_documents(docs, PATH, 16), 16) <= -(-total // 16) + 1


def test_the_index_finds_every_complement():
    rng = np.random.default_rng(3)
    for _ in range(200):
        left = np.zeros(41, np.int64)
        left[rng.integers(1, 41, 6)] = rng.integers(1, 3, 6)
        have = [x for x in range(41) for _ in range(left[x])]
        sums = {sum(c) for n in (1, 2, 3) for c in combinations(have, n)}
        index = packing.Complements(left)
        for gap in range(1, 41):
            found = index.exact(gap)
            assert (found is not None) == (gap in sums)
            assert found is None or (sum(found) == gap and all(left[x] >= n for x, n in Counter(found).items()))
