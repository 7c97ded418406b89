"""Streaming twins of the monitors, with state per key in the state store."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankloom.config import CanaryConfig, DriftConfig
from rankloom.operators.rollout import Canary, aborted, advanced, checked, percentage, started

DRIFT_OUTPUT = "model string, n bigint, kl double, status string, alerts int"
CANARY_OUTPUT = "canary string, tick bigint, action string, state string, stage int, percent int"


class DriftProcessor(StatefulProcessor):
    """Keeps each model's decayed histogram and baseline; tells a status at each ``every`` observations.

    Rows of a micro-batch are taken in the order of ``ts, event_id``; micro-batches in the order of arrival. A row of event type
    ``reset`` makes the present histogram the baseline and clears the alerts.
    """

    def __init__(self, every: int, config: DriftConfig = DriftConfig()):
        self.every, self.config = every, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", "n bigint, bins array<double>, baseline array<double>, alerts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self.config
        if self.state.exists():
            n, bins, baseline, alerts = self.state.get()
            bins, baseline = list(bins), list(baseline) if baseline is not None else None
        else:
            n, bins, baseline, alerts = 0, [0.0] * c.bins, None, 0
        out = []
        arrived = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind, bin_ in zip(arrived["kind"], arrived["bin"], strict=True):
            if kind == "reset":
                baseline, alerts = list(bins), 0
                continue
            if n:
                bins = [b * c.decay for b in bins]
            bins[bin_] += 1.0
            n += 1
            if n == c.warm_up:
                baseline = list(bins)
            if n % self.every == 0:
                kl, status, alerts = self._look(n, bins, baseline, alerts)
                out.append((key[0], n, kl, status, alerts))
        self.state.update((n, bins, baseline, alerts))
        yield pd.DataFrame(out, columns=["model", "n", "kl", "status", "alerts"])

    def _look(self, n: int, bins: list[float], baseline: list[float] | None, alerts: int):
        c = self.config
        if baseline is None:
            return None, "InsufficientData", alerts
        share = lambda h: [x / sum(h) for x in h] if sum(h) > 0 else [1.0 / c.bins] * c.bins
        kl = sum((p + c.epsilon) * math.log((p + c.epsilon) / (q + c.epsilon)) for p, q in zip(share(bins), share(baseline), strict=True))
        if n < c.least:
            return kl, "InsufficientData", alerts
        if kl > c.threshold:
            return kl, "Critical" if alerts + 1 >= c.critical_after else "Warning", alerts + 1
        return kl, "Recovered" if alerts else "Stable", 0

    def close(self) -> None:
        pass


def drift_stream(scores: DataFrame, every: int, config: DriftConfig = DriftConfig()) -> DataFrame:
    """Statuses of a stream ``model, ts, event_id, kind, score``. Needs the RocksDB state store."""
    from rankloom.functions.columns import histogram_bin

    rows = scores.select("model", "ts", "event_id", "kind", histogram_bin(F.col("score"), config.bins).alias("bin"))
    return rows.groupBy("model").transformWithStateInPandas(DriftProcessor(every, config), DRIFT_OUTPUT, "Update", "None")


class CanaryProcessor(StatefulProcessor):
    """Keeps each canary's stage; the transitions are those of the batch fold."""

    def __init__(self, config: CanaryConfig = CanaryConfig()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("canary", "state string, stage int, since double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = Canary(*self.state.get()) if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("tick").itertuples():
            c = c or started(r.at)
            if r.command == "abort":
                c, action = aborted(c), "Rollback"
            elif r.command == "advance":
                c, action = advanced(c, r.at, self.config)
            else:
                c, action = checked(c, r.at, r.drift, bool(r.latency_ok), self.config)
            out.append((key[0], r.tick, action, c.state, c.stage, percentage(c, self.config)))
        self.state.update((c.state, c.stage, c.since))
        yield pd.DataFrame(out, columns=["canary", "tick", "action", "state", "stage", "percent"])

    def close(self) -> None:
        pass


def canary_stream(ticks: DataFrame, config: CanaryConfig = CanaryConfig()) -> DataFrame:
    """The course of a stream ``canary, tick, at, drift, latency_ok, command``."""
    return ticks.groupBy("canary").transformWithStateInPandas(CanaryProcessor(config), CANARY_OUTPUT, "Update", "None")


def variant_stream(requests: DataFrame) -> DataFrame:
    """Running metrics by variant; percentiles from a bounded sketch, as a stream cannot keep all latencies."""
    fine = F.when(~F.col("is_error"), F.col("latency"))
    return requests.groupBy("variant").agg(
        F.count(fine).alias("n"),
        F.coalesce(F.avg(fine), F.lit(0.0)).alias("mean"),
        F.count_if("is_error").alias("errors"),
        F.percentile_approx(fine, [0.5, 0.95, 0.99], 10000).alias("p50_p95_p99"),
    )
