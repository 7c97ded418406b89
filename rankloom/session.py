"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``; a local master without one gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='rankloom-')).rstrip('/')}/rankloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it takes to know."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint, or left to the planner."""
    return F.broadcast(df) if small else df
