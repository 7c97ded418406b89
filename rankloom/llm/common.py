"""What the operators share: the shared folder, materialised tables, row hashes, bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of words, in the syntax that Java, RE2 and Python share.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: A side is broadcast only when the summed sizes of its rows stay under this.
BROADCAST_BYTES = 64 << 20

#: Folders of the steps that are under way, the innermost last.
_STEPS: ContextVar[tuple[str, ...]] = ContextVar("steps", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local master, as in tests, gets a temporary one, and any other
    an error: its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """Where ``materialised`` writes: the folder of the step that is under way, else that of this application."""
    return _STEPS.get()[-1] if _STEPS.get() else f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}"


@contextmanager
def step(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A step whose tables are dropped at its end. It gives a function that writes a table as ``materialised`` does, but for the time after."""
    outer = work_dir(spark)
    token = _STEPS.set((*_STEPS.get(), f"{outer}/step-{uuid.uuid4().hex}"))
    try:
        yield lambda df, name: written(df, f"{outer}/{name}-{uuid.uuid4().hex}")
    finally:
        drop(spark, work_dir(spark))
        _STEPS.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder; nothing if there is none."""
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most 1000 rows unless a number has been set, be it the default one: texts of some
    kilobytes would otherwise make batches of tens of megabytes, several times over in the JVM and in each Python worker. Plans take the
    number when they run, so it stays set."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "-7") == "-7":
        conf.set(key, "1000")
    return df


def packed_row(df: DataFrame, *without: str):
    """The columns of ``df`` but for some, as one struct ``row``: then no name of theirs meets a name used inside an operator."""
    names = [c for c in df.columns if c not in without]
    return F.struct(*(F.col(f"`{c}`") for c in names) if names else (F.lit(0).alias("none"),)).alias("row")


def unpacked(df: DataFrame, changed: dict[str, Column], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` again: those in ``changed`` as given there, the others out of ``row``."""
    return [(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in df.columns if c not in without]


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    return written(df, f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def forget(spark: SparkSession) -> None:
    """Deletes every table that ``materialised`` has written for this application."""
    drop(spark, f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}")


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType).cast("long"))
        return F.greatest(F.size(value), F.lit(0)) * 8 + F.lit(24)
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, all measured, are small enough together; else as it is, and the join shuffles."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once though the body uses it often or inside lambdas."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: two hashes with unrelated seeds."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def text_of(name: str) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))
