import os

import numpy as np
import pytest
from llm_support import with_clashes

from rankloom.llm import ann

VECTOR = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, every=20):
    ids = np.array([i for i, v in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        scores = (x * x[np.flatnonzero(ids == q)[0]]).sum(1)
        scores[ids == q] = -np.inf
        order = np.lexsort((ids, -scores))[:k]
        out[int(q)] = [(int(ids[i]), scores[i]) for i in order if scores[i] > -np.inf]
    return out


def search(spark, rows, k=20, **settings):
    frame = spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, 0) for i, v in rows], VECTOR)
    out = {}
    for r in ann.nearest_neighbours(frame, k, settings=ann.Settings(**settings)).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(found, want):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


@pytest.mark.parametrize("settings", [{}, {"block": 100, "queries": 7}, {"slice": 40, "columns": 5}])
def test_recall_and_scores(spark, settings):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24)) * 2
    rows = [(i, (centres[rng.integers(8)] + rng.normal(size=24)) * rng.uniform(0.2, 2)) for i in range(1500)]
    found, want = search(spark, rows, **settings), brute(rows, 20)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert recall(found, want) >= 0.9
    truth = dict(rows)
    for q, hits in found.items():
        assert q not in {i for i, _ in hits}
        a = np.array(truth[q], np.float32).astype(float)
        assert [s for _, s in hits] == pytest.approx([float(a @ np.array(truth[i], np.float32).astype(float)) for i, _ in hits], abs=1e-12)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_probes_reach_the_recall_on_vectors_that_were_not_fitted():
    rng = np.random.default_rng(5)
    x, sample = (rng.normal(size=(n, 16)) for n in (20_000, 4000))
    index = ann.Index(sample, 24_000, ann.Settings(), 20)
    queries = x[:300]
    products = queries @ x.T
    products[np.arange(300), np.arange(300)] = -np.inf
    best, near = np.argsort(-products, axis=1)[:, :20], index.nearest(x)
    probed = index.probed(queries, index.probes)
    assert ann.Settings().recall == 0.985
    assert np.mean([np.isin(near[b], p).mean() for b, p in zip(best, probed, strict=True)]) >= 0.975


def test_every_query_gets_its_rows_where_few_lists_are_probed(spark, monkeypatch):
    monkeypatch.setattr(ann.Index, "_needed", lambda *_: 1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12)) for i in range(1200)] + [(20, rng.normal(size=12)) for _ in range(60)] + [(5000, rng.normal(size=12) * 50)]
    found = search(spark, rows)
    assert len(found) == 61 and all(len(v) == 20 for v in found.values())


def test_a_scan_finds_what_reaches_its_bounds():
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(900, 24)), np.r_[np.zeros(300, int), np.arange(1, 601)]
    q, own = x[:140], ids[:140]
    products = np.where(ids[None, :] == own[:, None], -np.inf, q @ x.T)
    best = np.sort(products, axis=1)[:, ::-1]
    rotation = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    for bounds, epsilon in ((np.full(140, -np.inf), 99.0), (best[:, 9], 99.0), (best[:, 9], 3.0)):
        a, b, c = ann.scan(x, ids, q, own, bounds, rotation, 20, ann.Settings(slice=64, columns=8, epsilon=epsilon))
        want = 140 * (20 if np.isinf(bounds[0]) else 10)
        assert len(a) == want if epsilon == 99.0 else len(a) > 0.97 * want
        assert (np.bincount(a) <= 140 * 20).all() and np.isfinite(c).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    path = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), sf)
    frame = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    found, want = {}, brute(rows, 20)
    for r in ann.nearest_neighbours(with_clashes(frame.drop("id"))).collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and all(len(v) == min(20, len(rows) - 1) for v in found.values())
    assert recall(found, want) >= 0.95


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)] + [(i, [0.5, 0.1, 0.0]) for i in range(100, 140)]
    found = search(spark, rows, block=16)
    assert [i for i, _ in found[0]] == list(range(1, 21)) and [i for i, _ in found[60]] == list(range(20))


def test_awkward_vectors(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 25)]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [1.0, 2.0, 3.0]), (160, []), (None, [1.0, 1.0])]
    found = search(spark, good + bad)
    assert found == {20: [(i, pytest.approx(20.0 * i + 1)) for i in [24, 23, 22, 21, *range(19, 3, -1)]]}
    few = search(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])])
    assert few == {0: [(1, 2.0), (2, -1.0)]}
    assert search(spark, []) == {} and search(spark, [(0, [0.0])]) == {} and search(spark, [(0, [1.0])]) == {}


def test_repeated_rows_are_candidates_each(spark):
    found = search(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0])])
    assert found == {0: [(1, 0.5), (1, 0.5)]}
