import random
import re

from llm_support import DOCUMENT, PROSE, awkward, documents, empty, rows, with_clashes

from rankloom.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = [i for i, w in enumerate(windows) if windows.count(w) > 1] if len(windows) < 3000 else []
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len({k for i in twice for k in range(i, i + 8)})
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(words) < 20 or 100 * repeat > 30 * len(words)


def test_base_figures(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "#*$%&|<> x", "a " * 8, "a " * 9, "a " * 40, PROSE + "\n" + PROSE, "x y z w", "🙂 é漢 " * 30]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "c d", " ", "\n", "#", "\t", "e f g h i j k l "]) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 120))))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in Q.judged(documents(spark, texts)).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def prose(rng, n=40):
    return [" ".join(f"v{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n // 8)]


def verdicts(frame, **limits):
    return {r["doc_id"]: r["kept"] for r in Q.judged(frame, limits=Q.Limits(**limits)).collect()}


def test_common_lines_deplete(spark):
    rng = random.Random(8)
    menu = [f"Home {k} about contact news sports weather and more" for k in range(4)]
    texts = []
    for i in range(60):
        own = prose(rng)
        if i < 20:
            texts.append("\n".join([*menu, *own, *prose(rng)]))  # a menu above own prose
        elif i < 40:
            texts.append("\n".join(rng.sample(menu, 3) + [f"x{i}"]))  # hardly more than common lines
        else:
            texts.append("\n".join(own))
    got = verdicts(documents(spark, texts))
    assert all(got[i] for i in range(20)) and not any(got[i] for i in range(20, 40)) and all(got[i] for i in range(40, 60))


def test_copies_are_left_alone(spark):
    rng = random.Random(8)
    lines = prose(rng, 160)
    near = ["\n".join(lines[:k] + [f"changed {k}"] + lines[k + 1 :]) for k in range(20) for _ in range(2)]
    near += ["\n".join([f"head {k}", *lines, f"tail {k}"]) for k in range(30)]
    assert all(verdicts(documents(spark, ["\n".join(lines)] * 40 + near)).values())


def test_pages_made_of_a_template_are_rejected(spark):
    rng = random.Random(8)
    template = prose(rng, 80)
    pages = ["\n".join([*template, *prose(rng, 8)]) for _ in range(60)]
    menus = ["\n".join([*prose(random.Random(9), 40), f"title {i}"]) for i in range(30)]
    own = ["\n".join(prose(rng)) for _ in range(20)]
    got = verdicts(documents(spark, pages + menus + own))
    assert [got[i] for i in range(110)] == [False] * 90 + [True] * 20


def test_a_group_of_near_copies_counts_once(spark):
    rng = random.Random(8)
    lines = prose(rng, 240)
    copies = ["\n".join([*lines, f"tail {k}"]) for k in range(8)] + ["\n".join(lines)]
    others = ["\n".join([*lines[:20], *prose(rng, 24)]) for _ in range(3)]
    assert all(verdicts(documents(spark, copies + others)).values())


def test_hosts_are_apart(spark):
    rng = random.Random(8)
    menu = ["one menu line of eight words is here", "two menu line of eight words is here", "three menu line of eight words is here"]
    # half of the pages have prose of their own, half are hardly more than the menu
    texts = ["\n".join(menu + (prose(rng, 64) if i % 2 else [f"y{i}"])) for i in range(40)]
    rows_ = [(i, t, "en", f"host{i % 5}", 0) for i, t in enumerate(texts)]
    assert all(verdicts(spark.createDataFrame(rows_, DOCUMENT)).values())
    assert verdicts(documents(spark, texts)) == {i: i % 2 == 1 for i in range(40)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = Q.judged(with_clashes(docs))
    assert got.count() == docs.count() and rows(got.select("doc_id", "kept")) == rows(Q.judged(docs).select("doc_id", "kept"))
    assert Q.judged(empty(spark)).count() == 0 and Q.filtered(empty(spark)).count() == 0
    kept = Q.filtered(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert kept.where("doc_id = 6").count() == 2 and kept.where("doc_id in (1, 2, 3, 4, 9)").count() == 0


def test_filtered_texts_lose_common_lines(spark):
    rng = random.Random(8)
    docs = documents(spark, ["\n".join(["Skip to the main content of this page", *prose(rng)]) for _ in range(30)])
    got = Q.filtered(docs).collect()
    assert len(got) == 30 and all("Skip" not in r["text"] and r["n_chars"] == len(r["text"]) for r in got)
