import random
from fractions import Fraction

import numpy as np
from llm_support import awkward, documents, empty, rows, with_clashes

from rankloom.llm import components, ngram_join


def shingles(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """id: (smallest id of the class, links)."""
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for i in range(n):
        least[label[i]] = min(least.get(label[i], docs[i][0]), docs[i][0])
    return sorted((docs[i][0], least[label[i]], len(links[i])) for i in range(n))


def found(frame, **settings):
    return sorted(tuple(r) for r in ngram_join.near_duplicates(frame, settings=ngram_join.Settings(**settings)).select("doc_id", "class_id", "n_links").collect())


def family(rng, size, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
    return " ".join(words), " ".join(out)


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        size = rng.choice([1, 3, 5, 9, 30, 120, 400])
        base, _ = family(rng, size, 0)
        texts.append(base)
        for _ in range(rng.randrange(0, 4)):
            words = base.split()
            for _ in range(rng.randrange(0, 1 + size // 25)):
                words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_as_brute_force(spark):
    docs = corpus(1, 150)
    frame = documents(spark, [t for _, t in docs]).repartition(3)
    assert found(frame) == brute(docs)
    # blocks of a few texts give the same
    assert found(frame, block=3, exact_block=2) == brute(docs)


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(400):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    frame = documents(spark, [t for _, t in docs])
    assert found(frame, exact_block=64) == brute(docs)


def test_chains_are_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(8):
        docs.append((i, " ".join(words)))
        words = words[20:] + [f"n{i}x{k}" for k in range(20)]
    got = found(documents(spark, [t for _, t in docs]))
    assert got == brute(docs) and {c for _, c, _ in got} == {0} and len({n for _, _, n in got}) > 1


def test_depths_reach_the_recall():
    s = ngram_join.Settings()
    met = lambda similarity, depth: 1 - (1 - similarity**depth) ** s.trees
    for similarity in (0.8, 0.85, 0.9):
        depth = s.depth(similarity)
        assert met(similarity, depth) >= s.recall and (depth == s.deepest or met(similarity, depth + 1) < s.recall)
    assert s.stops[-1] == s.depth(0.8) and min(s.stops[1:]) == s.stops[-1] and max(s.stops) == s.deepest + 1
    assert ngram_join.Settings(recall=0.5).depth(0.8) > s.depth(0.8)


def test_least_links_by_size():
    s = ngram_join.Settings()
    for n in range(1, 41):
        all_ = [Fraction(c, n + m - c) for m in range(1, 60) for c in range(0, min(n, m) + 1) if not c == n == m]
        assert s.least_link(n) == min((x for x in all_ if x >= s.threshold), default=None)


def test_matches_in_the_sorted_tries(spark):
    rng = random.Random(2)
    settings = ngram_join.Settings(trees=3, deepest=4)
    rows = [(k, rng.choice([1, 2, 4]), [bytes(rng.choices([0, 1, 255], k=8)) for _ in range(3)]) for k in range(120)]
    frame = spark.createDataFrame(rows, "key bigint, stop int, labels array<binary>")
    values = lambda x: [x[i : i + 2] for i in range(0, 8, 2)]

    def shared(a, b):
        n = 0
        while n < 4 and values(a)[n] == values(b)[n]:
            n += 1
        return n

    want = set()
    for k, stop, labels in rows:
        for tree in range(3):
            longest = max(shared(labels[tree], other[2][tree]) for other in rows if other[0] != k)
            if longest >= stop:
                want.add((k, tree, longest))
    for partitions in ("1", "4", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = [tuple(r) for r in ngram_join.matched(frame, settings).select("key", "tree", "match").collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(got) == len(want) and set(got) == want


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngram_join.common_counts(sets)
    off = ~np.eye(20, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()
    assert (ngram_join.common_counts(sets[:4])[off[:4, :4]] == np.array(want)[:4, :4][off[:4, :4]]).all()


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = ngram_join.near_duplicates(with_clashes(docs)).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert [by[i] for i in (1, 2, 3)] == [[(1, 0)], [(2, 0)], [(3, 0)]]
    assert by[6] == [(6, 3), (6, 3)] and sorted(by[7]) == [(6, 3), (6, 3)]
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    left = ngram_join.one_of_each(with_clashes(docs))
    assert left.columns == with_clashes(docs).columns
    # 6, 6, 7 and 7 are one class; silent rows and others stay
    assert left.count() == docs.count() - 3 and left.where("doc_id in (6, 7)").count() == 1
    assert ngram_join.one_of_each(empty(spark)).count() == 0


def test_one_of_each_keeps_whole_rows(spark):
    docs = documents(spark, [" ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(51)), "other words"])
    assert rows(ngram_join.one_of_each(docs)) == rows(docs.where("doc_id <> 1"))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
