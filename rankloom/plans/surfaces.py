"""Queries that go through files, models and streams: what they write goes to a folder of the run, and what they return is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import sinks
from rankloom.config import CanaryConfig, ModelConfig, RerankConfig
from rankloom.operators import drift, rank, rollout, scorers
from rankloom.plans.queries import CHECKED, DRIFT, EVERY, ORACLES, query, requests, scores
from rankloom.session import table, work_dir
from rankloom.sources import beir, registry, tiny_onnx
from rankloom.streaming import monitor, serving

# --- models ---

SPLIT = "len(list_filter(string_split({}, ' '), lambda x : x <> ''))"


@query(f"""with r as (select item_id as qid, text as query, [text, text || ' and more', substr(text, 1, 20)] as documents from benchmark),
c as (select qid, query, unnest(documents) as doc, unnest(range(3)) as idx from r),
s as (select qid, idx, least(128, {SPLIT.format('query')} + {SPLIT.format('doc')}) as score from c)
select qid, cast(idx as integer) as idx, cast(score as double) as score, cast(rank as integer) as rank
from (select *, row_number() over (partition by qid order by score desc, idx) as rank from s) where rank <= 2""")
def onnx_rerank(spark, sf_dir):
    """A cross-encoder in ONNX over pairs; its logit is the pair's number of tokens, cut at the model's length."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = F.array("query", F.concat("query", F.lit(" and more")), F.substring("query", 1, 20))
    scorer = scorers.OnnxScorer(tiny_onnx.counting_model(), tiny_onnx.word_tokenizer(), ModelConfig(max_length=128), RerankConfig(normalize_scores=False))
    return rank.rerank(b.select("qid", "query", F.posexplode(docs).alias("idx", "doc")), scorer, 2).select("qid", "idx", "score", "rank")


@query("""select 'org/' || n_name as model_id, 'u' || n_nationkey as source_url, cast(n_nationkey * 10 as bigint) as file_size_bytes,
  case when n_nationkey % 2 = 0 then 'INT8' end as precision from nation""")
def model_cache(spark, sf_dir):
    """Metadata of models written to a cache folder and listed from there; one that was deleted and one that is no JSON are not listed."""
    root = work_dir(spark)
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        fields = {"source_url": f"u{r['n_nationkey']}", "sha256": "s", "download_date": "0s since epoch", "file_size_bytes": r["n_nationkey"] * 10}
        fields |= {"precision": "INT8"} if r["n_nationkey"] % 2 == 0 else {}
        registry.write_metadata(spark, registry.snapshot_folder(root, f"org/{r['n_name']}", "r1"), model_id=f"org/{r['n_name']}", **fields)
    registry.write_metadata(spark, registry.snapshot_folder(root, "org/gone", "r1"), model_id="org/gone", source_url="u", sha256="s", file_size_bytes=1)
    registry.delete_model(spark, root, "org/gone")
    registry.write_text(spark, f"{registry.snapshot_folder(root, 'org/bad', 'r1')}/cache.json", "{not json")
    return registry.cached_models(spark, root).select("model_id", "source_url", "file_size_bytes", "precision")


@query("""select 'q' as kind, i as id, 'what is known about subject ' || i as text from range(7) t(i)
union all select 'd', i, 'document ' || i || ' tells what is known about subject ' || (i % 7) || ' and part ' || (i % 7) from range(50) t(i)""")
def workload(spark, sf_dir):
    q, d = registry.workload(spark, 7, 50)
    return q.select(F.lit("q").alias("kind"), F.col("qid").alias("id"), F.col("query").alias("text")).unionByName(d.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"))


# --- datasets ---


def written_dataset(spark: SparkSession, sf_dir: str, split: str, query_id: Callable) -> str:
    """``benchmark`` and ``documents`` as files of a dataset, with judgments of each query on two documents and on some unknown ones."""
    root = work_dir(spark)
    b = table(spark, sf_dir, "benchmark").select(query_id(F.col("item_id")).alias("_id"), F.col("text"), F.col("item_id"))
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("_id"), F.when(F.col("doc_id") % 2 == 0, "Title").otherwise("").alias("title"), "text")
    b.select(F.to_json(F.struct("_id", "text")).alias("value")).write.text(f"{root}/queries.jsonl")
    d.select(F.to_json(F.struct("_id", "title", "text")).alias("value")).write.text(f"{root}/corpus.jsonl")
    judged = b.select(
        F.col("_id").alias("query-id"),
        F.explode(F.array(*(F.struct(i.cast("string").alias("corpus-id"), s.alias("score")) for i, s in ((F.col("item_id") * 7 % 200, F.lit("2")), (F.col("item_id") * 3 % 200, F.lit("many")), (F.lit(-5), F.lit("1")))))).alias("j"),
    ).select("query-id", "j.*").where("`query-id` not like '%9'")
    judged.write.option("sep", "\t").option("header", True).csv(f"{root}/qrels/{split}.tsv")
    return root


JUDGED_FILES = """j as (
  select item_id, item_id * 7 % 200 as doc_id, 2 as rel, 0 as turn from benchmark where cast(item_id as varchar) not like '%9'
  union all select item_id, item_id * 3 % 200, 0, 1 from benchmark where cast(item_id as varchar) not like '%9'
), kept as (select item_id, doc_id, max_by(rel, turn) as rel from j group by item_id, doc_id)"""


@query(f"""with {JUDGED_FILES}
select 'q' || item_id as qid, cast(doc_id as varchar) as doc_id, cast(rel as smallint) as rel, cast(length(text) + case when doc_id % 2 = 0 then 6 else 0 end as integer) as chars
from kept join documents using (doc_id) where text is not null""")
def beir_load(spark, sf_dir):
    data = beir.load_beir(spark, written_dataset(spark, sf_dir, "test", lambda i: F.concat(F.lit("q"), i)))
    return data.judged.join(data.corpus, "doc_id").select("qid", "doc_id", "rel", F.length("text").alias("chars"))


@query(f"""with {JUDGED_FILES},
asked as (select item_id from (select distinct item_id from kept) order by 'query' || item_id limit 20),
needed as (select distinct doc_id from kept join asked using (item_id)),
spoken as (select doc_id from documents where text is not null),
others as (select doc_id from spoken where doc_id not in (select doc_id from needed) order by cast(doc_id as varchar) limit 50)
select 'query' || item_id as id, 'query' as kind from asked
union all select cast(doc_id as varchar), 'document' from spoken where doc_id in (select doc_id from needed union all select doc_id from others)""")
def msmarco_load(spark, sf_dir):
    """Ids that begin like the header are no headers."""
    root = written_dataset(spark, sf_dir, "dev", lambda i: F.concat(F.lit("query"), i))
    data = beir.load_msmarco(spark, root, max_queries=20, extra=50)
    return data.queries.select(F.col("qid").alias("id"), F.lit("query").alias("kind")).unionByName(data.corpus.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")))


# --- responses ---

ANSWERS = """with r as (select cast(item_id as varchar) as qid, text as query, [text, text || '!', substr(text, 1, 20)] as documents from benchmark),
c as (select qid, unnest(documents) as doc, unnest(range(3)) as idx from r),
s as (select *, row_number() over (partition by qid order by length(doc) desc, idx) as rank from c)
select qid, '{"results":[' || string_agg('{"index":' || idx || ',"score":' || length(doc) || '.0}', ',' order by rank) || ']}' as response from s where rank <= 2 group by qid"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"), F.array("text", F.concat("text", F.lit("!")), F.substring("text", 1, 20)).alias("documents"), F.lit(2).alias("top_k"), F.lit(False).alias("return_documents"))


@query(ANSWERS)
def response_json(spark, sf_dir):
    return serving.answered(asked(spark, sf_dir), scorers.ColumnScorer(F.length("doc"))).select("qid", "response")


@query("select event_type, round(avg(value), 6) as mean, max(value) as high from events group by event_type")
def result_json(spark, sf_dir):
    """Results appended to JSON lines in two writes and read back."""
    path = work_dir(spark)
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))
    for part in (F.col("event_type") < "m", F.col("event_type") >= "m"):
        sinks.append_json(found.where(part), path)
    return spark.read.schema(found.schema).json(path)


# --- status rows ---


@query(f"{ORACLES['drift_status'].rpartition('select model, n, case')[0]}"
       """, seen as (select model, max(n) as samples from requests group by model), look as (select model, max_by(alerts, n) as alerts, max_by(kl, n) as kl from alerts group by model)
select model, samples >= 200 as baseline_established, samples, greatest(200 - samples, 0) as warm_up_left, cast(coalesce(alerts, 0) as integer) as alerts,
  case when samples >= 200 then round(kl, 6) end as kl, 0.4::double as threshold from seen left join look using (model)""")
def drift_summary(spark, sf_dir):
    rows = scores(spark, sf_dir)
    found = drift.summary(drift.checks(rows, EVERY, DRIFT), rows, DRIFT)
    return found.withColumn("kl", F.round("kl", 6)).withColumn("samples", F.col("samples").cast("long")).withColumn("warm_up_left", F.col("warm_up_left").cast("long"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)") / 1000.0
    late = (F.col("value") > 150) & (F.col("event_id") % 5 == 0)
    return requests(spark, sf_dir).select(
        F.col("model").alias("canary"),
        F.col("n").cast("long").alias("tick"),
        at.alias("at"),
        F.when(late, "Warning").otherwise("Stable").alias("drift"),
        rollout.within_tolerance(F.col("value"), F.lit(200.0), CanaryConfig(tolerance=1.25)).alias("latency_ok"),
        F.lit(None).cast("string").alias("command"),
    )


COURSE = ORACLES["canary_fold"].rpartition("select model as canary")[0].replace("value < 250 as ok", "value <= 250 as ok")


@query(f"""{COURSE}, ended as (select model, max_by(struct_pack(s := state, g := stage, f := since), tick) as l from course where tick > 0 group by model),
clock as (select model, max_by(t0, tick) as now from ticks group by model)
select model as canary, l.s as state, l.g as stage, cast(case when l.s = 'Active' then [1, 5, 25, 100][l.g + 1] else 0 end as integer) as percent, round(now - l.f, 0) as elapsed,
  round(case when l.s = 'Active' then greatest(0, 3600 - (now - l.f)) else 0 end, 0) as remaining, 1.25::double as tolerance from ended join clock using (model)""")
def canary_status(spark, sf_dir):
    found = rollout.canary_status(ticks(spark, sf_dir), CanaryConfig(observation_seconds=3600.0, tolerance=1.25))
    return found.withColumns({c: F.round(c, 0) for c in ("elapsed", "remaining")})


# --- streams ---

STREAMS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "8"}


def streamed(spark: SparkSession, rows: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` of a stream of ``rows`` writes until they are used up; the stream has settings of its own while it starts and runs."""
    folder = work_dir(spark)
    rows.coalesce(1).write.parquet(f"{folder}/in")
    stream = made(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    before = {k: spark.conf.get(k) for k in STREAMS}
    for k, v in STREAMS.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, number: batch.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(ORACLES["drift_status"])
def drift_stream_status(spark, sf_dir):
    """The stream's statuses are those of the batch."""
    rows = requests(spark, sf_dir).select("model", "ts", "event_id", F.lit("score").alias("kind"), (F.col("value") / 100).cast("float").alias("score"))
    found = streamed(spark, rows, lambda s: monitor.drift_stream(s, EVERY, DRIFT))
    return found.select("model", F.col("n").cast("int").alias("n"), F.when(~F.isnan("kl"), F.round("kl", 6)).alias("kl"), "status", "alerts")


@query(ORACLES["canary_fold"].replace("value < 250 as ok", "value <= 250 as ok"))
def canary_stream_fold(spark, sf_dir):
    return streamed(spark, ticks(spark, sf_dir), lambda s: monitor.canary_stream(s, CanaryConfig(observation_seconds=3600.0)))


@query(f"select qid, response, case when {'('}'0x' || substr(md5(qid), 1, 8))::bigint % 100 < 70 then 'a' else 'b' end as variant, false as is_error from ({ANSWERS})")
def serve_stream(spark, sf_dir):
    """JSON requests as a stream, routed to two variants, scored and answered."""
    folder = work_dir(spark)
    asked(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{folder}/in")
    lines = spark.readStream.schema("value string").text(f"{folder}/in")
    scorer = scorers.ColumnScorer(F.length("doc"))
    writer = serving.serve(lines, {"a": scorer, "b": scorer}, (70, 30), lambda rows, number: rows.write.mode("append").parquet(f"{folder}/out"))
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("qid", "response", "variant", "is_error")
