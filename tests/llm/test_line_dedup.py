import random

from llm_support import DOCUMENT, PROSE, awkward, documents, empty, rows, with_clashes

from rankloom.llm import line_dedup


def brute(docs, least):
    """Deletes the lines of every run of ``least`` words and more that some earlier place has too. docs: (id, text)."""
    spoken = [[x.strip(" \t\x0b\x0c\r") for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")] for _, t in docs]
    order = sorted(range(len(docs)), key=lambda d: (docs[d][0] is None, docs[d][0] or 0))
    seen, out = {}, [set() for _ in docs]
    places = [(d, i) for d in order for i in range(len(spoken[d]))]
    for d, i in places:
        words, run = 0, []
        for j in range(i, len(spoken[d])):
            run.append(spoken[d][j])
            words += len(spoken[d][j].split())
            key = tuple(run)
            if words >= least and key in seen:
                out[d].update(range(i, j + 1))
            seen.setdefault(key, (d, i))
    return out, [len(s) for s in spoken]


def found(frame, least):
    return {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_dedup.deduplicated(frame, least).collect()}


def test_as_brute_force(spark):
    rng = random.Random(2)
    for least in (4, 9):
        docs = []
        for i in range(60):
            lines = [" ".join(["ab"[rng.randrange(2)]] * rng.randrange(1, 4)) if rng.random() < 0.9 else " \t" for _ in range(rng.randrange(0, 12))]
            docs.append((i, "\n".join(lines)))
        docs += [(100, docs[5][1]), (101, "\n".join([docs[3][1], docs[4][1]])), (102, None)]
        frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCUMENT).repartition(3)
        gone, sizes = brute(docs, least)
        assert {k: v[:2] for k, v in found(frame, least).items()} == {i: (n, len(g)) for (i, _), g, n in zip(docs, gone, sizes, strict=True)}


def test_runs_longer_than_windows(spark):
    line = lambda k: " ".join(f"t{k}w{i}" for i in range(7))
    shared = [line(k) for k in range(40)]
    texts = ["\n".join([line(90), *shared, line(91)]), "\n".join([line(92), *shared[5:33], line(93)]), "\n".join([*shared[10:16], line(94)])]
    got = found(documents(spark, texts), 50)
    assert [got[i][1] for i in range(3)] == [0, 28, 0]
    assert got[1][2] == line(92) + "\n" + line(93)


def test_a_run_within_one_text_keeps_its_first_place(spark):
    part = "\n".join(" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    assert found(documents(spark, [f"{part}\nmiddle\n{part}\nend"]), 50)[0] == (6, 2, f"{part}\nmiddle\nend")


def test_copies_of_texts(spark):
    got = found(documents(spark, [PROSE, "x y", PROSE, "x y", PROSE]), 50)
    assert {k: v[1] for k, v in got.items()} == {0: 0, 1: 0, 2: 6, 3: 0, 4: 6} and got[2][2] == ""


def test_awkward_rows(spark):
    docs = awkward(spark)
    plain = line_dedup.deduplicated(docs, 50)
    assert plain.columns == [*docs.columns, "n_lines", "n_deleted"] and plain.count() == docs.count()
    odd = line_dedup.deduplicated(with_clashes(docs), 50)
    assert rows(odd.select(plain.columns)) == rows(plain)
    assert sorted(r["n_deleted"] for r in plain.where("doc_id in (6, 7)").collect()) == [0, 5, 6, 6]
    assert line_dedup.deduplicated(empty(spark), 50).count() == 0
    kept = line_dedup.filtered(with_clashes(docs), 50)
    assert kept.columns == with_clashes(docs).columns and line_dedup.filtered(empty(spark), 50).count() == 0
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id is null").count() == 2


def test_plan_has_no_cross_join(spark):
    plan = line_dedup.deduplicated(documents(spark, [PROSE] * 3), 50)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ranks_are_places_in_the_suffix_array(spark):
    rows = [((i * 7) % 50, i % 3, 1 + i % 4) for i in range(50)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, n bigint")
    before, want = 0, {}
    for a, b, n in sorted(rows):
        want[(a, b)] = before
        before += n
    for partitions in ("1", "4", "40"):
        held = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert {(r["a"], r["b"]): r["rank"] for r in line_dedup.ranked(frame, ["a", "b"]).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", held)
    assert line_dedup.ranked(frame.limit(0), ["a", "b"]).count() == 0
