"""Token counts kept as additive totals.

Batches of events (documents inserted, deleted, or counted anew) are reduced to signed deltas by source, language and tokenizer
version, by partial sums, so that a source with a third of all rows is a few rows after each task. A batch is first written to the
ledger, without the events that committed batches hold; its deltas are summed from there, and the success mark of that write commits it:
committing it again changes nothing, and a commit that was cut short leaves nothing that is read. Totals are the sum of the base and
of the deltas of batches that it does not hold yet.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import hadoop_path

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, docs bigint, tokens bigint"


def inserted(docs: DataFrame, event_id, version: str, tokens) -> DataFrame:
    """An insert event per row of ``docs`` (``source, lang``) with its count under one tokenizer version."""
    return docs.select(event_id.alias("event_id"), F.lit("insert").alias("kind"), "source", "lang", F.lit(version).alias("version"), tokens.cast("long").alias("tokens"), F.lit(0).cast("long").alias("prior"))


def once(events: DataFrame) -> DataFrame:
    """``events`` (``event_id, kind, source, lang, version, tokens, prior``) each once, with ``a, b`` for its id and kind.

    An event that is delivered again, under the same id and kind, counts once; if the copies differ, the largest counts. Null counts
    are zero; null sources, languages and versions are keys like others. Events without an id are each other's copies if all else is
    equal, within a batch only: across batches nothing tells a copy from a new event, and ``a, b`` are null.
    """
    body = F.struct("source", "lang", "version", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("prior", F.lit(0)).cast("long").alias("prior"))
    unnamed = F.when(F.col("event_id").isNull(), body)
    rows = events.groupBy("event_id", "kind", unnamed.alias("_body")).agg(F.max(body).alias("e"))
    named = F.col("event_id").isNotNull()
    a, b = F.xxhash64("event_id", "kind"), F.xxhash64(F.lit("second"), "event_id", "kind")
    return rows.select(F.when(named, a).alias("a"), F.when(named, b).alias("b"), "kind", "e.*")


def deltas(events: DataFrame) -> DataFrame:
    """Signed sums of events, each ``once``.

    ``insert`` adds a document and its tokens, ``delete`` takes them away, ``revise`` replaces ``prior`` tokens by ``tokens``; any other
    kind is an error. No events give no deltas; columns other than those of an event are not looked at.
    """
    return summed(once(events))


def summed(rows: DataFrame) -> DataFrame:
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    change = F.when(F.col("kind") == "revise", F.col("tokens") - F.col("prior")).otherwise(sign * F.col("tokens"))
    return rows.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(change).cast("long").alias("tokens"))


class Rollup:
    """Totals in a folder that the driver and all executors see. One commit follows another; compaction may run beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, folder: str) -> set[str]:
        """Names of the folders below that hold a success mark."""
        root, fs = hadoop_path(self.spark, f"{self.path}/{folder}")
        if not fs.exists(root):
            return set()
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return {n for n in names if fs.exists(hadoop_path(self.spark, f"{self.path}/{folder}/{n}/_SUCCESS")[0])}

    def _snapshot(self) -> tuple[str | None, set[str], set[str]]:
        """The newest base, the batches it holds, and those committed besides, from one look at each folder: whatever is derived from a
        snapshot takes a batch as held, as one more, or not at all."""
        base = max(self._committed("base"), default=None, key=int)
        held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/base/{base}/batches").collect()} if base else set()
        return base, held, self._committed("deltas") - held

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Adds a batch; False, and nothing is done, if it has been committed before. Events that earlier batches hold under the same id
        and kind are passed over."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        _, held, more = self._snapshot()
        if batch in held | more:
            return False
        rows = once(events)
        if known := sorted(held | more):
            seen = self.spark.read.schema("a bigint, b bigint").parquet(*(f"{self.path}/ledger/{b}" for b in known))
            rows = rows.join(seen, ["a", "b"], "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        summed(self.spark.read.schema(rows.schema).parquet(f"{self.path}/ledger/{batch}")).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        return True

    def _totals(self, base: str | None, batches: set[str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{b}" for b in sorted(batches)]
        paths += [f"{self.path}/base/{base}/totals"] if base else []
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` of keys with documents or tokens."""
        base, _, more = self._snapshot()
        return self._totals(base, more)

    def _claimed(self) -> int:
        """A number that no other base has: the file that claims it is made by one caller only."""
        root, fs = hadoop_path(self.spark, f"{self.path}/base")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        number = max([0, *(int(n.rpartition("-")[2]) for n in names)]) + 1
        while True:
            claim, _ = hadoop_path(self.spark, f"{self.path}/base/claim-{number}")
            if fs.createNewFile(claim):
                return number
            number += 1

    def compact(self) -> None:
        """Puts all committed deltas into a new base. It counts from its own success mark on, which is written last; its totals and its list
        of batches come from one snapshot, so a batch that is committed meanwhile stays outside both."""
        base, held, more = self._snapshot()
        folder = f"{self.path}/base/{self._claimed()}"
        self._totals(base, more).write.mode("overwrite").parquet(f"{folder}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(held | more)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/batches")
        mark, fs = hadoop_path(self.spark, f"{folder}/_SUCCESS")
        fs.create(mark, True).close()
