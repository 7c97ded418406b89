"""Canary rollout and micro-batches: pure transitions, and their folds over recorded rows.

A fold walks through a key's rows in order with a state of a few fields; rows stream past in Arrow batches sorted by key and
time, so that a key of any length takes the memory of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import BatchConfig, CanaryConfig


@dataclass(frozen=True)
class Canary:
    """``state``: Inactive, Active, RollingBack or Completed."""

    state: str = "Inactive"
    stage: int = 0
    since: float = 0.0


def percentage(c: Canary, config: CanaryConfig) -> int:
    return config.stages[c.stage] if c.state == "Active" and c.stage < len(config.stages) else 0


def started(now: float) -> Canary:
    return Canary("Active", 0, now)


def aborted(c: Canary) -> Canary:
    return replace(c, state="RollingBack", stage=0)


def advanced(c: Canary, now: float, config: CanaryConfig) -> tuple[Canary, str]:
    """The next stage at once; nothing unless active."""
    if c.state != "Active":
        return c, "None"
    if c.stage + 1 >= len(config.stages):
        return replace(c, state="Completed", stage=c.stage + 1), "Complete"
    return Canary("Active", c.stage + 1, now), f"Advance({config.stages[c.stage + 1]})"


def checked(c: Canary, now: float, drift: str, latency_ok: bool, config: CanaryConfig) -> tuple[Canary, str]:
    """One look at an active canary: back on drift, then on latency; else on when its stage has lasted long enough."""
    if c.state != "Active":
        return c, "None"
    if drift in ("Warning", "Critical") or not latency_ok:
        return replace(c, state="RollingBack"), "Rollback"
    if now - c.since < config.observation_seconds:
        return c, "None"
    return advanced(c, now, config)


def remaining(c: Canary, now: float, config: CanaryConfig) -> float:
    """Seconds that the stage still has to last."""
    return max(0.0, config.observation_seconds - (now - c.since)) if c.state == "Active" else 0.0


def within_tolerance(latency: Column, baseline: Column, config: CanaryConfig = CanaryConfig()) -> Column:
    """Whether a canary's latency is at most the baseline's times the tolerance; so without a baseline."""
    return F.coalesce(latency <= baseline * config.tolerance, F.lit(True))


def folded(rows: DataFrame, key: str, order: list[str], columns: list[str], step: Callable, schema: str) -> DataFrame:
    """A row for each of ``rows``: key, then what ``step(state, *values of columns)`` returns after the new state; state starts as None."""
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or k != now:
                    now, state, begun = k, None, True
                state, *told = step(state, *values)
                out.append(told)
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], _ARROW[x.split()[1]]) for i, x in enumerate(schema.split(", ")))], names=[key, *names])

    return dealt.mapInArrow(run, f"`{key}` {kind}, {schema}")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def canary_course(ticks: DataFrame, config: CanaryConfig = CanaryConfig()) -> DataFrame:
    """``canary, tick, action, state, stage, percent`` for each of ``ticks`` (``canary, tick, at`` in seconds, ``drift, latency_ok, command``).

    A canary starts with its first tick. ``command`` may be ``advance`` or ``abort``; otherwise the tick is a check.
    """

    def step(c, tick, at, drift, ok, command):
        c = c or started(at)
        if command == "abort":
            c, action = aborted(c), "Rollback"
        elif command == "advance":
            c, action = advanced(c, at, config)
        else:
            c, action = checked(c, at, drift, ok, config)
        return c, tick, action, c.state, c.stage, percentage(c, config)

    return folded(ticks, "canary", ["tick"], ["tick", "at", "drift", "latency_ok", "command"], step, "tick bigint, action string, state string, stage int, percent int")


def canary_status(ticks: DataFrame, config: CanaryConfig = CanaryConfig()) -> DataFrame:
    """``canary, state, stage, percent, elapsed, remaining, tolerance`` of each canary after its last tick (of ``ticks``, as for
    ``canary_course``): seconds that its stage has lasted at that tick and still has to last."""
    course = canary_course(ticks, config)
    turns = course.where(F.col("action").startswith("Advance")).groupBy("canary").agg(F.max("tick").alias("turn"))
    ends = course.groupBy("canary").agg(F.max("tick").alias("tick"), F.max_by(F.struct("state", "stage", "percent"), "tick").alias("last"))
    times = ticks.select(F.col("canary").alias("_c"), F.col("tick").alias("_t"), "at")
    begun = ticks.groupBy("canary").agg(F.min_by("at", "tick").alias("first"))
    found = ends.join(turns, "canary", "left").join(begun, "canary")
    found = found.join(times, (F.col("canary") == F.col("_c")) & (F.col("tick") == F.col("_t"))).drop("_c", "_t").withColumnRenamed("at", "now")
    found = found.join(times, (F.col("canary") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    elapsed = F.col("now") - F.coalesce("at", "first")
    left = F.when(F.col("last.state") == "Active", F.greatest(F.lit(0.0), F.lit(config.observation_seconds) - elapsed)).otherwise(0.0)
    return found.select("canary", "last.state", "last.stage", "last.percent", elapsed.alias("elapsed"), left.alias("remaining"), F.lit(config.tolerance).alias("tolerance"))


def batches(arrivals: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """``stream, request_id, batch_id, place`` for ``arrivals`` (``stream, request_id, at`` in seconds).

    A batch opens with a request and takes those that follow until it is full or its wait, from the first on, is over.
    """

    def step(state, request, at):
        number, opened, size = state or (-1, 0.0, 0)
        if state is None or size >= config.max_batch or at - opened > config.max_wait_seconds:
            number, opened, size = number + 1, at, 0
        return (number, opened, size + 1), request, number, size

    return folded(arrivals, "stream", ["at", "request_id"], ["request_id", "at"], step, "request_id bigint, batch_id bigint, place int")
