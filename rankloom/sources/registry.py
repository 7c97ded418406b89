"""The model cache as a table, and other small sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.errors import CacheError
from rankloom.functions.names import cache_folder, epoch_text

METADATA = (
    "model_id STRING, source_url STRING, sha256 STRING, download_date STRING, file_size_bytes BIGINT, "
    "precision STRING, gpu_arch STRING, trt_version STRING, platt_a DOUBLE, platt_b DOUBLE"
)
REQUIRED = ("model_id", "source_url", "sha256", "download_date", "file_size_bytes")
REQUEST = "qid STRING, query STRING, documents ARRAY<STRING>, top_k INT, return_documents BOOLEAN"


def _placed(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop objects: local or shared alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, from the driver."""
    p, fs = _placed(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def snapshot_folder(root: str, model_id: str, revision: str) -> str:
    return f"{root}/{cache_folder(model_id)}/snapshots/{revision}"


def cached_models(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all cached snapshots; files that are no valid JSON or lack a required field are passed over."""
    pattern, fs = _placed(spark, f"{root}/models--*/snapshots/*/*cache.json")
    if not fs.globStatus(pattern):
        return spark.createDataFrame([], METADATA)
    rows = spark.read.schema(METADATA).option("mode", "DROPMALFORMED").option("multiLine", True).json(pattern.toString())
    return rows.dropna(subset=list(REQUIRED))


def write_metadata(spark: SparkSession, folder: str, **fields) -> None:
    """A snapshot's metadata file; absent fields are left out."""
    known = [f.split()[0] for f in METADATA.split(", ")]
    if unknown := set(fields) - set(known):
        raise CacheError(f"unknown fields {sorted(unknown)}")
    fields = {"download_date": epoch_text()} | fields
    write_text(spark, f"{folder}/cache.json", json.dumps({k: fields[k] for k in known if fields.get(k) is not None}))


def delete_model(spark: SparkSession, root: str, model_id: str) -> None:
    folder, fs = _placed(spark, f"{root}/{cache_folder(model_id)}")
    if not fs.exists(folder):
        raise CacheError(f"{model_id} is not cached")
    fs.delete(folder, True)


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder, without those of folders below."""
    rows = spark.read.format("binaryFile").load(path).select("length")
    return rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def workload(spark: SparkSession, queries: int, docs: int) -> tuple[DataFrame, DataFrame]:
    """Synthetic ``queries`` (``qid, query``) and ``corpus`` (``doc_id, text``), made by the executors."""
    q = spark.range(queries).select(F.col("id").alias("qid"), F.format_string("what is known about subject %d", "id").alias("query"))
    d = spark.range(docs).select(F.col("id").alias("doc_id"), F.format_string("document %d tells what is known about subject %d and part %d", "id", F.pmod("id", F.lit(max(1, queries))), F.pmod("id", F.lit(7))).alias("text"))
    return q, d


def requests_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests from JSON text, batch or stream; text that is no request is an error."""
    return lines.select(F.from_json(column, REQUEST, {"mode": "FAILFAST"}).alias("r")).select("r.*")
