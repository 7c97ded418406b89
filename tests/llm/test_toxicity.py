import os
import random
import re
import zlib

import numpy as np
import zstandard
from llm_support import DOCUMENT, awkward, empty, rows, with_clashes

from rankloom.llm import toxicity as T

LABEL = "doc_id bigint, quality int, toxic int"
VILE = ["zorkface", "blightwit", "gutterfink", "mudgrub", "quaxhead"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "the", "in", "er", "tion", "on", "re", "ly", "sh", "ha", "st", "en"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(15, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(VILE) + rng.choice(["", "s", "ed"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    found = {r["doc_id"]: r for r in T.judged(spark.createDataFrame(docs, DOCUMENT), spark.createDataFrame(labels, LABEL)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [(found[i], y) for i, _, y in labels if found[i]["held_out"]]
    right = np.mean([r["predicted"] == y for r, y in held])
    assert right > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())


def test_held_out_labels_are_not_seen(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, DOCUMENT)
    lies = [(i, q, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, q, y in labels]
    assert rows(T.judged(frame, spark.createDataFrame(labels, LABEL))) == rows(T.judged(frame, spark.createDataFrame(lies, LABEL)))


def test_whole_texts_are_read(spark):
    docs, labels = corpus(600)
    late = (5000, docs[3][1] + " plain words" * 30_000 + " " + " ".join(VILE * 40), "en", "s", 0)
    plain = (5001, docs[3][1] + " plain words" * 30_000, "en", "s", 0)
    found = {r["doc_id"]: r["score"] for r in T.judged(spark.createDataFrame([*docs, late, plain], DOCUMENT), spark.createDataFrame(labels, LABEL)).collect()}
    assert found[5000] > found[5001]


def test_awkward_rows(spark):
    docs, labels = corpus(200)
    known = spark.createDataFrame([*labels, (None, None, None), (1, None, None), (2, 0, 7), (77777, 1, 1)], LABEL)
    frame = spark.createDataFrame(docs, DOCUMENT).unionByName(awkward(spark))
    found = T.judged(with_clashes(frame), with_clashes(known)).collect()
    assert len(found) == frame.count() and all(0 <= r["score"] <= 1 for r in found)
    assert T.judged(empty(spark), known).count() == 0
    kept = T.filtered(with_clashes(frame), known)
    assert kept.columns == with_clashes(frame).columns
    assert kept.count() == sum(r["predicted"] == 0 for r in found)


def test_without_labels_the_score_is_a_constant(spark):
    docs, labels = corpus(40)
    frame = spark.createDataFrame(docs, DOCUMENT)
    for known in ([], [(i, 1, 0) for i, _, _ in labels]):
        found = T.judged(frame, spark.createDataFrame(known, LABEL))
        assert {r["predicted"] for r in found.collect()} == {0}


def auc(scores, marked):
    """The share of pairs of a marked and an unmarked row that the scores put in the right order."""
    a, b = scores[marked], np.sort(scores[~marked])
    return (np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).mean() / 2 / len(b)


def test_held_out_labels_of_the_table(spark):
    """A part of the labels follows no word of the text, so that no score can reach them: 0.82 is the area of telling all others."""
    at = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), "sf0.1")
    docs, labels = (spark.read.parquet(f"{at}/{name}.parquet") for name in ("documents", "labels"))
    found = T.judged(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "toxic").toPandas()
    toxic = found["toxic"].to_numpy() == 1
    scores = found["score"].to_numpy()
    assert auc(scores, toxic) > 0.72
    assert (scores[toxic] >= 0.7).mean() > 0.4 and (scores[~toxic] >= 0.7).mean() < 0.03


def plain_score(model, text):
    """The score of a text, step by step."""
    d = model.dictionaries
    options = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_BTOPT, min_match=3, search_log=4, window_log=17, chain_log=17, hash_log=17, target_length=16, write_content_size=False, write_dict_id=False, write_checksum=False
    )

    def size(content, data):
        held = zstandard.ZstdCompressionDict(d.header + content, dict_type=zstandard.DICT_TYPE_FULLDICT)
        held.precompute_compress(compression_params=options)
        return len(zstandard.ZstdCompressor(compression_params=options, dict_data=held).compress(data))

    words = [w.strip(".,;:!?\"()") for w in re.split(r"[\x20\x09-\x0D]+", text.lower())]
    words = [w for w in words if w]
    saved = []
    for i in range(0, max(1, len(words)), 6):
        data = (" " + " ".join(words[i : i + 6]) + " ").encode()
        saved.append(size(d.ordinary, data) - size(d.ordinary + d.toxic, data))
    best = sorted(saved, reverse=True)
    x = [best[0], sum(saved) / len(saved), sum(best[:3]) / len(best[:3]), sum(best[:6]) / len(best[:6])]
    x += [sum(s >= t for s in saved) / len(saved) for t in (1, 2, 3, 4, 5, 6)]
    x += [np.log(1 + sum(s >= t for s in saved)) for t in (2, 3, 4, 5, 6, 8)] + [np.log(len(saved))]
    z = sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.scale, strict=False)) + model.weights[-1]
    return 1 / (1 + np.exp(-z))


def test_scores_against_a_plain_computation(spark):
    docs, labels = corpus(400)
    frame = spark.createDataFrame(docs, DOCUMENT)
    model = T.fitted(frame, spark.createDataFrame(labels, LABEL))
    assert model.dictionaries.header and model.dictionaries.toxic and T.HEADER_END in model.dictionaries.header
    texts = [d[1] for d in docs[:40]] + ["", " \t", "(One) two, three!"]
    found = T.scored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), model).collect()
    for r in found:
        assert abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-9


def test_the_sample_is_bounded_and_whole(spark):
    docs, labels = corpus(300)
    frame, known = spark.createDataFrame(docs, DOCUMENT), spark.createDataFrame(labels, LABEL)
    few = T.sampled(frame.unionByName(frame), known.unionByName(known), T.Sample(toxic=20, ordinary=30)).collect()
    assert len(few) == len({r["id"] for r in few}) and sum(r["toxic"] for r in few) <= 20 and len(few) <= 50
    assert all(r["text"] == docs[r["id"]][1] for r in few)
    assert len(T.sampled(frame, known, T.Sample()).collect()) == len(labels)
