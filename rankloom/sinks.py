"""Sinks: results and reports as JSON lines, and a record of a stream's progress."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener


def append_json(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; absent values leave no field."""
    rows.write.mode("append").option("ignoreNullFields", True).json(path)


class Progress(StreamingQueryListener):
    """Hands each micro-batch's numbers, and what ``observe`` has gathered in it, to ``tell`` as a dictionary."""

    def __init__(self, tell):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        fields = {k: p.get(k) for k in ("id", "batchId", "numInputRows", "processedRowsPerSecond", "observedMetrics")}
        self.tell({"event": "progress", **fields})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"event": "terminated", "id": str(event.id), "error": event.exception})
