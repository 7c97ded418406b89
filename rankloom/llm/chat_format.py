"""Chat formatting from an event log.

A conversation is a log of events. Events are dealt out by conversation and message, sorted by sequence and
folded into final messages; the messages are rendered as turns of a template that escapes control strings in
texts reversibly and marks what training counts in its loss.

A message is the unit of dealing, so one conversation that holds a third of all events spreads over all tasks
up to the point where its turns are read in order. There they stream through one pass that keeps one turn at a
time in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers around the text of a turn, by role; any other role is written out.
MARKERS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[SEP]", "[/ROLE]")

#: A control string, with as many backslashes after its first character as escaping has put there.
CONTROL = r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE|SEP)\])"
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?(?:INST|SYS|ROLE|SEP)\])")
TURN = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[SYS\](.*?)\[/SYS\]|\[ROLE\](.*?)\[SEP\](.*?)\[/ROLE\]", re.S)


def escaped(text: Column) -> Column:
    """Every control string in the text gets one more backslash after its first character."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def events_from_turns(turns: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as events, their messages named by ``turn`` and ``tie``. Rows that tie on a turn stay
    apart, ordered by role and text. What is dealt by conversation and turn here need not be dealt again to be folded."""
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return turns.select(
        "conv_id",
        F.col("turn").alias("seq"),
        "turn",
        F.row_number().over(tie).alias("tie"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def fold_events(events: DataFrame, message: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """Final messages from events ``conv_id, seq, message_id, kind, role, text``; ``message`` are the columns that name a message.

    ``message`` and ``edit`` set a message's text, ``regenerate`` clears it for the deltas that follow, ``delta``
    appends, ``delete`` takes the message away unless a later event sets it again. A message stands where its first
    event stands. Its role is the last one given. Null roles and texts count as empty; an unknown kind is an error;
    ties in ``seq`` are ordered by kind, role and text. No events give no messages.
    Returns ``conv_id, message_id, place, role, text``.
    """
    whole = Window.partitionBy("conv_id", *message)
    order = whole.orderBy("seq", "kind", "role", "text")
    kind = F.when(F.col("kind").isin("message", "edit", "regenerate", "delta", "delete"), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null")))).cast("string")
    )
    ranked = events.withColumn("kind", kind).withColumn("_n", F.row_number().over(order))
    ranked = ranked.withColumn("_from", F.max(F.when(F.col("kind") != "delta", F.col("_n"))).over(whole)).withColumn("_place", F.min("seq").over(whole))
    ranked = ranked.withColumn("_role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_n"))).over(whole))
    live = ranked.where(F.col("_n") >= F.coalesce("_from", F.lit(0)))
    piece = F.struct("_n", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    folded = live.groupBy("conv_id", *message).agg(
        F.min("_place").alias("place"),
        F.coalesce(F.max("_role"), F.lit("")).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"),
        F.max_by("kind", "_n").alias("_last"),
        F.max(F.when(F.col("kind") == "delete", F.col("_n"))).alias("_deleted"),
        F.max("_n").alias("_end"),
    )
    name = F.col(message[0]) if len(message) == 1 else F.struct(*message)
    name = name.alias("message_id")
    return folded.where(F.col("_deleted").isNull() | (F.col("_deleted") < F.col("_end"))).select("conv_id", name, "place", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One segment per message: ``conv_id, place, message_id, segment, loss_start, loss_end``.

    A conversation's formatted text is its segments in order of place and message. The loss span is in code points
    from the segment's start; it is empty but for assistants, where it is the text without its markers.
    """
    text = escaped(F.col("text"))
    role = F.col("role")
    segment = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (left, right) in MARKERS.items():
        segment = F.when(role == name, F.concat(F.lit(left), text, F.lit(right))).otherwise(segment)
    left, right = MARKERS["assistant"]
    out = messages.select("conv_id", "place", "message_id", segment.alias("segment"), (role == "assistant").alias("_loss"))
    return out.select(
        "conv_id",
        "place",
        "message_id",
        "segment",
        F.when(F.col("_loss"), len(left)).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("_loss"), F.length("segment") - len(right)).otherwise(0).cast("long").alias("loss_end"),
    )


def in_order(segments: DataFrame) -> DataFrame:
    """Segments dealt by conversation and sorted, so that a task meets each conversation's text from start to end."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "place", "message_id")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Reader:
    """Reads one conversation's formatted text as it streams past."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def feed(self, segment: str, start: int, end: int) -> None:
        self.chars += len(segment)
        if end > start:
            spoken = unescaped(segment[start:end])
            self.loss_chars += len(spoken)
            self.loss.update(spoken.encode("utf-8", "surrogatepass"))
        text, at = self.rest + segment, 0
        while m := TURN.match(text, at):
            if (k := m.lastindex) == 5:
                role, said = unescaped(m[4]), unescaped(m[5])
            else:
                role, said = ("user", "assistant", "system")[k - 1], unescaped(m[k])
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            at = m.end()
        self.rest = text[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("formatted text ends within a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, reader, done = None, None, []

    def out():
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema=schema)

    for batch in batches:
        for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if reader is None or conv != now:
                if reader is not None:
                    done.append((now, *reader.row()))
                now, reader = conv, _Reader()
            reader.feed(segment, start, end)
        if len(done) >= 1000:
            yield out()
            done = []
    if reader is not None:
        done.append((now, *reader.row()))
    yield out()


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say when read by their markers and loss spans: one digest row per conversation."""
    return in_order(segments).select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_digests, DIGEST)


def formatted_texts(segments: DataFrame) -> DataFrame:
    """Whole formatted texts, ``conv_id, formatted``; for conversations that fit a row."""
    part = F.struct("place", "message_id", "segment")
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["segment"]), "").alias("formatted"))


def format_conversations(events: DataFrame, message: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """Rendered segments of an event log; see ``fold_events`` and ``render``."""
    return render(fold_events(events, message))
