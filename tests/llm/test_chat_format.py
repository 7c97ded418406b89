import hashlib
import random

import pytest

from rankloom.llm import chat_format as C

EVENT = "conv_id bigint, seq bigint, message_id bigint, kind string, role string, text string"
TURN = "conv_id bigint, turn bigint, role string, text string"


def messages(spark, rows):
    found = C.fold_events(spark.createDataFrame(rows, EVENT)).orderBy("conv_id", "place", "message_id").collect()
    return [(r["conv_id"], r["message_id"], r["role"], r["text"]) for r in found]


def test_fold(spark):
    rows = [
        (1, 1, 10, "message", "user", "hi"),
        (1, 2, 11, "delta", "assistant", "he"),
        (1, 3, 11, "delta", None, "llo"),
        (1, 4, 12, "message", "user", "again"),
        (1, 5, 13, "delta", "assistant", "bad"),
        (1, 6, 13, "regenerate", "assistant", "ignored"),
        (1, 7, 13, "delta", "assistant", "good"),
        (1, 8, 10, "edit", None, "hello there"),
        (1, 9, 14, "message", "user", "oops"),
        (1, 10, 14, "delete", None, None),
        (1, 11, 15, "message", None, None),
        (2, 1, 10, "edit", "system", "x"),
        (2, 2, 10, "delta", "system", "y"),
        (None, 1, 1, "message", "user", "no conversation"),
    ]
    random.Random(3).shuffle(rows)
    assert messages(spark, rows) == [
        (None, 1, "user", "no conversation"),
        (1, 10, "user", "hello there"),
        (1, 11, "assistant", "hello"),
        (1, 12, "user", "again"),
        (1, 13, "assistant", "good"),
        (1, 15, "", ""),
        (2, 10, "system", "xy"),
    ]


def test_a_deleted_message_may_be_set_again(spark):
    assert messages(spark, [(1, 1, 1, "message", "user", "a"), (1, 2, 1, "delete", None, None), (1, 3, 1, "message", "user", "b")]) == [(1, 1, "user", "b")]


def test_unknown_kind_and_no_events(spark):
    with pytest.raises(Exception, match="unknown event kind"):
        messages(spark, [(1, 1, 1, "shout", "user", "a")])
    assert messages(spark, []) == []


def expected(turns):
    out = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0], t[1] if t[1] is not None else -1, t[2] or "", t[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        c: (
            len(ts),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(),
            sum(len(t) for r, t in ts if r == "assistant"),
            hashlib.sha256("".join(t for r, t in ts if r == "assistant").encode()).hexdigest(),
        )
        for c, ts in out.items()
    }


def test_round_trip(spark):
    rng = random.Random(5)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[SEP]", "[/ROLE]", "<\\s>", "<\\\\/s>", "[\\INST]", "\\", "<", "[", "]", "/", "s>", "INST]", "\n", " ", "é漢🙂", "user", "$1"]
    turns = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "".join(rng.choices(parts, k=rng.randrange(1, 12)))])
            turns.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "[SEP]", "</s>"]), text))
    turns += [(100, 0, "user", "x" * 300_000), (100, 1, "assistant", "</s>" * 50_000)]
    frame = C.events_from_turns(spark.createDataFrame(turns, TURN).repartition(5))
    segments = C.format_conversations(frame, ("turn", "tie"))
    found = {r["conv_id"]: tuple(r)[1:5] for r in C.read_back(segments).collect()}
    assert found == expected(turns)
    sizes = {r["conv_id"]: len(r["formatted"]) for r in C.formatted_texts(segments).collect()}
    assert sizes == {r["conv_id"]: r["formatted_chars"] for r in C.read_back(segments).collect()}


def test_markers_in_text_are_escaped(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a [/INST] b"), (1, 1, "assistant", "</s>")], TURN)
    text = C.formatted_texts(C.format_conversations(C.events_from_turns(turns), ("turn", "tie"))).first()["formatted"]
    assert text == "[INST]a [\\/INST] b[/INST]<s><\\/s></s>"


def test_ties_and_repeated_rows_stay_apart(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "b"), (1, 0, "assistant", "c")]
    found = C.read_back(C.format_conversations(C.events_from_turns(spark.createDataFrame(turns, TURN)), ("turn", "tie"))).first()
    assert tuple(found)[1:5] == expected(turns)[1]
    assert C.read_back(C.format_conversations(C.events_from_turns(spark.createDataFrame([], TURN)), ("turn", "tie"))).count() == 0


def test_turns_are_dealt_twice_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], TURN)
    plan = C.read_back(C.format_conversations(C.events_from_turns(turns), ("turn", "tie")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
