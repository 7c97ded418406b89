"""The engine's queries over the test tables, each with SQL that says the same.

Queries of the retrieval kind take ``benchmark`` as queries, ``documents`` as corpus and, as judgments, which documents contain a
query's text. Those of the serving kind take ``events`` as traffic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import BatchConfig, CanaryConfig, CascadeConfig, DriftConfig, FusionConfig
from rankloom.functions import columns as C
from rankloom.operators import calibration, cascade, drift, evaluation, experiment, fusion, matching, rank, retrieval, rollout, scorers, statistics
from rankloom.session import table, work_dir
from rankloom.sources.registry import requests_from_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- tables ---


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, doc_id, inter, nq, nd``: each query with the documents that share a token with it.

    All of a document's tokens lie in one row, so its pairs are counted in its own task.
    """
    q, docs = bm25_inputs(spark, sf_dir)
    return retrieval.overlaps(q, docs)


#: Scores over ``pairs``: a logit of the share of the query's tokens, and the Jaccard similarity of the token sets.
OVERLAP = scorers.ColumnScorer("inter * 6.0D / nq - 3.0D", normalize=True)
JACCARD = scorers.ColumnScorer("inter / (nq + nd - inter)")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("idx", F.col("doc_id")).withColumn("doc", F.lit(None).cast("string"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, doc_id, rel``: 2 if the document begins with the query's text, 1 if it contains it elsewhere.

    A text that contains another has all its tokens but for the outermost two, so only such pairs are searched.
    """
    near = pairs(spark, sf_dir).where(F.col("inter") >= F.col("nq") - 2).select("qid", "doc_id")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = near.join(q, "qid").join(docs, "doc_id").select("qid", "doc_id", F.instr("text", F.col("query")).alias("at"))
    return at.where("at > 0").select("qid", "doc_id", F.when(F.col("at") == 1, 2).otherwise(1).cast("int").alias("rel"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as requests: a model for each type, ``n`` counting its requests."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "model")
    return drift.numbered(e)


WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t : t <> '')"
PAIRS = rf"""
dw as (select doc_id, list_distinct({WORDS}) as w from documents),
qw as (select item_id as qid, list_distinct({WORDS}) as w from benchmark),
dt as (select doc_id, len(w) as nd, unnest(w) as token from dw),
qt as (select qid, len(w) as nq, unnest(w) as token from qw),
pairs as (
  select qid, doc_id, count(*) as inter, any_value(nq) as nq, any_value(nd) as nd from qt join dt using (token) group by qid, doc_id
),
scored as (
  select *, 1 / (1 + exp(-(inter * 6.0::double / nq - 3))) as overlap, inter::double / (nq + nd - inter) as jaccard from pairs
)"""
JUDGED = """
judged as (
  select item_id as qid, doc_id, case when strpos(d.text, b.text) = 1 then 2 else 1 end as rel
  from benchmark b join documents d on contains(d.text, b.text)
)"""
REQUESTS = "requests as (select *, event_type as model, row_number() over (partition by event_type order by ts, event_id) as n from events)"


def bucket(key: str, n: int) -> str:
    return f"(('0x' || substr(md5(cast({key} as varchar)), 1, 8))::bigint % {n})"


# --- ranking ---


@query(f"""with {PAIRS}
select qid, doc_id as idx, round(overlap, 6) as score, cast(rank as integer) as rank
from (select *, row_number() over (partition by qid order by overlap desc, doc_id) as rank from scored) where rank <= 10""")
def rerank_topk(spark, sf_dir):
    return rank.rerank(candidates(spark, sf_dir), OVERLAP, 10).select("qid", "idx", F.round("score", 6).alias("score"), "rank")


@query(f"""with {PAIRS}
select qid, doc_id as idx, round(overlap, 6) as score, cast(rank as integer) as rank, text as document
from (select *, row_number() over (partition by qid order by overlap desc, doc_id) as rank from scored) join documents using (doc_id) where rank <= 3""")
def rerank_attach_docs(spark, sf_dir):
    best = rank.rerank(candidates(spark, sf_dir), OVERLAP, 3)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("document"))
    return best.join(docs, "idx").select("qid", "idx", F.round("score", 6).alias("score"), "rank", "document")


@query("""with r as (
  select item_id as qid, text as query, [text, text || '!', substr(text, 1, 20)] as documents, cast(item_id % 4 as integer) as top_k from benchmark
), c as (
  select qid, top_k, unnest(documents) as doc, unnest(range(3)) as idx from r
), s as (
  select *, row_number() over (partition by qid order by length(doc) desc, idx) as rank from c
)
select qid, cast(idx as integer) as idx, cast(length(doc) as double) as score, cast(rank as integer) as rank, doc as document from s where rank <= top_k""")
def request_json_roundtrip(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    made = b.select(
        F.to_json(
            F.struct(
                F.col("item_id").cast("string").alias("qid"),
                F.col("text").alias("query"),
                F.array("text", F.concat("text", F.lit("!")), F.substring("text", 1, 20)).alias("documents"),
                (F.col("item_id") % 4).cast("int").alias("top_k"),
                F.lit(True).alias("return_documents"),
            )
        ).alias("value")
    )
    scored = scorers.ColumnScorer(F.length("doc")).score(rank.requests_to_candidates(requests_from_json(made)))
    return rank.top_k(scored, "top_k").select(F.col("qid").cast("long").alias("qid"), "idx", "score", "rank", F.col("doc").alias("document"))


# --- calibration ---


@query("select event_id, round(1 / (1 + exp(-(value / 100 - 1))), 9) as prob from events")
def sigmoid_calibrate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(C.sigmoid(F.col("value") / 100 - 1), 9).alias("prob"))


@query("select event_id, round(1 / (1 + exp(-1.7::double * (value / 100) + 0.3::double)), 9) as prob from events")
def platt_apply(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(C.platt(F.col("value") / 100, -1.7, 0.3), 9).alias("prob"))


LABELLED = "labelled as (select doc_id, cast(ln(1 + n_chars) / 2 - 3 as float) as score, quality = 1 as label from documents join labels using (doc_id) where quality is not null)"


def labelled(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels.where("quality is not null"), "doc_id")
    return rows.select("doc_id", (F.ln(F.lit(1) + F.col("n_chars")) / 2 - 3).cast("float").alias("score"), (F.col("quality") == 1).alias("label"))


@query(f"""with {LABELLED}, p as (select 1 / (1 + exp(-score::double)) as prob, label from labelled)
select round(coalesce(sum(abs(p - y)) / sum(n), 0), 9) as ece
from (select least(floor(prob * 10), 9) as bin, count(*) as n, sum(prob) as p, sum(label::integer) as y from p group by bin)""")
def ece_10(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(C.sigmoid(F.col("score")).alias("prob"), "label")
    return calibration.expected_calibration_error(rows, 10).select(F.round("ece", 9).alias("ece"))


@query(f"""with recursive {LABELLED},
sizes as (select count(*) filter (label) as pos, count(*) filter (not label) as neg from labelled),
d as (select score::double as f, case when label then (pos + 1.0::double) / (pos + 2) else 1.0::double / (neg + 2) end as t from labelled, sizes),
steps(i, a, b, moved) as (
  select 0, 0.0::double, ln((neg + 1.0::double) / (pos + 1)), 1.0::double from sizes
  union all
  select i + 1, a + (h21 * g2 - h22 * g1) / det, b + (h21 * g1 - h11 * g2) / det, greatest(abs((h21 * g2 - h22 * g1) / det), abs((h21 * g1 - h11 * g2) / det))
  from (
    select i, a, b, h11, h22, h21, g1, g2, h11 * h22 - h21 * h21 as det from (
      select i, a, b, 1e-3 + sum(f * f * p * (1 - p)) as h11, 1e-3 + sum(p * (1 - p)) as h22, sum(f * p * (1 - p)) as h21, sum(f * (t - p)) as g1, sum(t - p) as g2
      from (select i, a, b, f, t, 1 / (1 + exp(a * f + b)) as p from steps, d where moved >= 1e-5 and i < 100) group by i, a, b
    )
  )
)
select round(a, 6) as a, round(b, 6) as b from steps order by i desc limit 1""")
def platt_fit(spark, sf_dir):
    a, b = calibration.fit_platt(labelled(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(a), 6).alias("a"), F.round(F.lit(b), 6).alias("b"))


# --- fusion ---

LISTS = f"""{PAIRS},
a as (select * from (select qid, doc_id, overlap as score, row_number() over (partition by qid order by overlap desc, doc_id) - 1 as r from scored) where r < 50),
b as (select * from (select qid, doc_id, jaccard as score, row_number() over (partition by qid order by jaccard desc, doc_id) - 1 as r from scored) where r < 50)"""


def two_lists(spark, sf_dir):
    base = pairs(spark, sf_dir)  # the best of each list are cut where pairs are made; two lists are two passes over the corpus
    return [fusion.as_list(s.score(base), i).where(F.col("rank0") < 50) for i, s in enumerate((OVERLAP, JACCARD))]


def _fused(wa: float, wb: float) -> str:
    return f"""with {LISTS}
select qid, doc_id, round(sum(part), 9) as score from (
  select qid, doc_id, {wa}::double / (61 + r) as part from a union all select qid, doc_id, {wb}::double / (61 + r) from b
) group by qid, doc_id"""


@query(_fused(1, 1))
def rrf_two_lists(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(two_lists(spark, sf_dir)).select("qid", "doc_id", F.round("score", 9).alias("score"))


@query(f"""select qid, doc_id, score, cast(row_number() over (partition by qid order by score desc, doc_id) as integer) as rank from ({_fused(1, 1)})""")
def rrf_ranked(spark, sf_dir):
    fused = fusion.reciprocal_rank_fusion(two_lists(spark, sf_dir))
    return fused.select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(_fused(0.3, 0.7))
def rrf_weighted(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(two_lists(spark, sf_dir), FusionConfig(60.0, (0.3, 0.7))).select("qid", "doc_id", F.round("score", 9).alias("score"))


@query(f"with {LISTS} select qid, doc_id, round(score, 9) as score from a")
def rrf_single_list(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(two_lists(spark, sf_dir)[:1]).select("qid", "doc_id", F.round("score", 9).alias("score"))


@query(_fused(0.75, 0.25))
def hybrid_alpha(spark, sf_dir):
    return fusion.hybrid(*two_lists(spark, sf_dir), alpha=0.25).select("qid", "doc_id", F.round("score", 9).alias("score"))


# --- cascade ---

ZONES = "case when overlap::float >= 0.6::float then 'high' when overlap::float >= 0.15::float then 'uncertain' else 'reject' end"


@query(f"with {PAIRS} select qid, zone, count(*) as n from (select qid, {ZONES} as zone from scored) group by qid, zone")
def cascade_zones(spark, sf_dir):
    scored = OVERLAP.score(pairs(spark, sf_dir))
    return scored.groupBy("qid", cascade.zone(F.col("score"), CascadeConfig(0.6, 0.15)).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {PAIRS}, merged as (
  select qid, doc_id, case {ZONES} when 'high' then overlap else 0.5 + jaccard / 2 end as score from scored where {ZONES} <> 'reject'
)
select qid, doc_id as idx, round(score, 9) as score, cast(rank as integer) as rank
from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from merged) where rank <= 10""")
def cascade_rerank(spark, sf_dir):
    big = scorers.ColumnScorer(f"0.5D + {JACCARD.expression} / 2")
    out = cascade.cascade(candidates(spark, sf_dir), OVERLAP, big, 10, CascadeConfig(0.6, 0.15))
    return out.select("qid", "idx", F.round("score", 9).alias("score"), "rank")


# --- retrieval ---

BM25 = rf"""
dl as (select doc_id, {WORDS} as w from documents),
qw as (select item_id as qid, list_distinct({WORDS}) as w from benchmark),
qt as (select qid, len(w) as nq, unnest(w) as token from qw),
n as (select count(*) as n, avg(len(w)) as mean from dl),
tf as (select doc_id, length, token, count(*) as tf from (select doc_id, len(w) as length, unnest(w) as token from dl) where token in (select token from qt) group by all),
df as (select token, count(*) as df from tf group by token),
bm as (
  select qid, doc_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean))) as score
  from qt join tf using (token) join df using (token), n group by qid, doc_id
),
found as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) - 1 as idx from bm)"""


def bm25_inputs(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return q, table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"with {BM25} select qid, cast(idx as integer) as idx, doc_id, round(score, 6) as score from found where idx < 10")
def bm25_topk(spark, sf_dir):
    q, docs = bm25_inputs(spark, sf_dir)
    return retrieval.Bm25(docs).search(q, 10).withColumn("score", F.round("score", 6))


@query(f"""with {BM25},
dw as (select doc_id, list_distinct(w) as w from dl),
c as (
  select f.qid, f.idx, f.doc_id, 1 / (1 + exp(-(len(list_intersect(qw.w, dw.w)) * 6.0::double / len(qw.w) - 3))) as score
  from found f join qw using (qid) join dw using (doc_id) where idx < 100
)
select qid, cast(idx as integer) as idx, doc_id, round(score, 6) as score, cast(rank as integer) as rank
from (select *, row_number() over (partition by qid order by score desc, idx) as rank from c) where rank <= 10""")
def two_stage(spark, sf_dir):
    q, docs = bm25_inputs(spark, sf_dir)
    return retrieval.two_stage(retrieval.Bm25(docs), q, docs, scorers.LexicalScorer(), 100, 10).withColumn("score", F.round("score", 6))


# --- vectors ---


#: Queries of a vector search that one pass takes; more of them go in blocks.
VECTOR_BLOCK = 20_000


def in_query_blocks(queries, search):
    """``search`` for each block of ``queries`` (``qid, ...``), which tasks can hold; the blocks' rows together."""
    blocks = max(1, -(-queries.count() // VECTOR_BLOCK))
    out = None
    for i in range(blocks):
        part = search(queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow())
        out = part if out is None else out.unionByName(part)
    return out


@query("""with v as (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
s as (select q.vec_id as qid, d.vec_id as doc_id, round(case when q.n * d.n = 0 then 0 else list_inner_product(q.e, d.e) / (q.n * d.n) end, 9) as score from v q, v d where q.vec_id % 20 = 0)
select qid, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s) where rank <= 10""")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vector")
    near = in_query_blocks(asked, lambda q: matching.nearest_by_cosine(v, q, 10))
    return rank.top_k(near.withColumn("idx", F.col("doc_id")), 10).select("qid", "doc_id", "score", "rank")


@query("""with v as (select vec_id // 8 as owner, vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
best as (
  select q.owner as qid, d.owner as doc_id, q.vec_id, max(case when q.n * d.n = 0 then 0 else list_inner_product(q.e, d.e) / (q.n * d.n) end) as c
  from v q, v d where q.owner % 20 = 0 group by q.owner, d.owner, q.vec_id
)
select qid, doc_id, round(1 / (1 + exp(-sum(c))), 9) as score from best group by qid, doc_id""")
def maxsim(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 8").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    docs = tokens.select(F.col("owner").alias("doc_id"), F.col("t.embedding").alias("vectors"))
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vectors")
    summed = in_query_blocks(asked, lambda q: matching.late_interaction(docs, q))
    return summed.select("qid", "doc_id", F.round(C.sigmoid(F.col("score")), 9).alias("score"))


@query("""with v as (select vec_id // 8 as owner, vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
best as (
  select q.owner as qid, q.vec_id, max(case when q.n * d.n = 0 then 0 else list_inner_product(q.e, d.e) / (q.n * d.n) end) as c from v q join v d on d.owner = q.owner + 1 group by q.owner, q.vec_id
)
select qid, qid + 1 as doc_id, round(1 / (1 + exp(-sum(c))), 9) as score from best group by qid""")
def maxsim_pairs(spark, sf_dir):
    """Pairs that are given: each owner with the next."""
    tokens = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 8").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    q = tokens.select(F.col("owner").alias("qid"), F.col("t.embedding").alias("query_vectors"), (F.col("owner") + 1).alias("doc_id"))
    docs = tokens.select(F.col("owner").alias("doc_id"), F.col("t.embedding").alias("doc_vectors"))
    return scorers.LateInteractionScorer().score(q.join(docs, "doc_id")).select("qid", "doc_id", F.round("score", 9).alias("score"))


# --- evaluation ---


@query(f"with {JUDGED} select qid, doc_id, rel from judged")
def qrels_join(spark, sf_dir):
    return judgments(spark, sf_dir)


@query(f"with {JUDGED} select item_id as qid from benchmark where item_id in (select qid from judged)")
def judged_queries(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return q.join(judgments(spark, sf_dir), "qid", "left_semi")


@query(f"""with {JUDGED},
have as (select qid, count(*) as have from judged group by qid),
placed as (select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) - 1 as pos, count(*) over () as total from documents),
drawn as (select h.qid, have, doc_id, (pos - {bucket("'42|' || qid", 2**31)} % total + total) % total as turn from have h, placed),
pool as (
  select qid, doc_id, have, row_number() over (partition by qid order by turn) as n from drawn d where not exists (select 1 from judged j where j.qid = d.qid and j.doc_id = d.doc_id)
)
select qid, doc_id, rel, cast(row_number() over (partition by qid order by doc_id) - 1 as integer) as idx from judged
union all select qid, doc_id, 0, cast(have + n - 1 as integer) from pool where n <= 20 - have""")
def negatives_sampled(spark, sf_dir):
    judged = judgments(spark, sf_dir)
    return evaluation.sampled_negatives(judged.select("qid").distinct(), table(spark, sf_dir, "documents"), judged, 20)


EVALUATED = f"""{PAIRS}, {JUDGED},
ranking as (select qid, doc_id, row_number() over (partition by qid order by overlap desc, doc_id) as rank from scored),
shown as (select qid, rank, coalesce(rel, 0) as rel from ranking left join judged using (qid, doc_id) where rank <= 10),
dcg as (select qid, sum((2 ** rel - 1) / log2(rank + 1)) as dcg, count(*) as n from shown group by qid),
best as (select qid, rel, row_number() over (partition by qid order by rel desc, doc_id) as rank from judged),
idcg as (select qid, sum((2 ** rel - 1) / log2(rank + 1)) as idcg from best join dcg using (qid) where rank <= least(10, n) group by qid),
ndcg as (select qid, case when coalesce(idcg, 0) > 0 then dcg / idcg else 0 end as ndcg from dcg left join idcg using (qid)),
rr as (select qid, coalesce(1.0::double / min(rank) filter (rel > 0), 0) as rr from ranking left join judged using (qid, doc_id) group by qid)"""


def ranking(spark, sf_dir):
    return rank.ranked(OVERLAP.score(candidates(spark, sf_dir))).select("qid", "doc_id", "rank")


@query(f"with {EVALUATED} select qid, round(ndcg, 9) as ndcg from ndcg")
def ndcg_at_10(spark, sf_dir):
    return evaluation.ndcg_at(ranking(spark, sf_dir), judgments(spark, sf_dir), 10).withColumn("ndcg", F.round("ndcg", 9))


@query(f"with {EVALUATED} select qid, round(rr, 9) as rr from rr")
def mrr(spark, sf_dir):
    return evaluation.reciprocal_rank(ranking(spark, sf_dir), judgments(spark, sf_dir)).withColumn("rr", F.round("rr", 9))


@query(f"""with {EVALUATED}, per as (select qid, ndcg, rr from ndcg join rr using (qid))
select 'all' as policy, round(avg(coalesce(ndcg, 0)), 9) as ndcg, round(avg(coalesce(rr, 0)), 9) as rr, count(*) as n_queries from benchmark left join per on qid = item_id
union all select 'judged', round(avg(ndcg), 9), round(avg(rr), 9), count(*) from per where qid in (select qid from judged)""")
def eval_macro(spark, sf_dir):
    shown, judged = ranking(spark, sf_dir), judgments(spark, sf_dir)
    per = evaluation.ndcg_at(shown, judged, 10).join(evaluation.reciprocal_rank(shown, judged), "qid")
    everyone = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    means = [evaluation.macro_mean(per, everyone), evaluation.macro_mean(per.join(judged, "qid", "left_semi"))]
    parts = [m.select(F.lit(p).alias("policy"), F.round("ndcg", 9).alias("ndcg"), F.round("rr", 9).alias("rr"), "n_queries") for p, m in zip(("all", "judged"), means, strict=True)]
    return parts[0].unionByName(parts[1])


# --- statistics ---


@query("""with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(value) filter (i = n // 2) as p50, max(value) filter (i = least(floor(n * 0.95::double), n - 1)) as p95,
  max(value) filter (i = least(floor(n * 0.99::double), n - 1)) as p99, round(avg(value), 6) as mean, round(count(*) * 1000.0::double / sum(value), 6) as qps
from s group by event_type""")
def latency_stats(spark, sf_dir):
    out = statistics.latency_stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "p50", "p95", "p99", F.round("mean", 6).alias("mean"), F.round("qps", 6).alias("qps"))


VARIANTS = f"v as (select *, case when {bucket('user_id', 100)} < 70 then 'a' else 'b' end as variant, event_type = 'error' as is_error from events)"


@query(f"""with {VARIANTS},
s as (select variant, value, row_number() over (partition by variant order by value) - 1 as i, count(*) over (partition by variant) as n from v where not is_error),
p as (select variant, max(value) filter (i = n * 50 // 100) as p50, max(value) filter (i = least(n * 95 // 100, n - 1)) as p95, max(value) filter (i = least(n * 99 // 100, n - 1)) as p99 from s group by variant)
select variant, count(*) filter (not is_error) as n, round(coalesce(sum(value) filter (not is_error), 0), 6) as total, round(coalesce(avg(value) filter (not is_error), 0), 6) as mean,
  count(*) filter (is_error) as errors, any_value(p50) as p50, any_value(p95) as p95, any_value(p99) as p99
from v join p using (variant) group by variant""")
def ab_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(C.hash_variant(F.col("user_id"), 70, 30).alias("variant"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("is_error"))
    return statistics.variant_metrics(e).withColumns({c: F.round(c, 6) for c in ("total", "mean")})


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as low, max(value) as high from events group by event_type")
def score_distribution(spark, sf_dir):
    out = statistics.score_distribution(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


SERVER = """m as (
  select count(*) as requests, count(*) filter (event_type = 'error') as errors, sum(value / 1000) / count(*) as avg_latency, avg(1 + event_id % 32) as avg_batch from events
)"""


def served(spark, sf_dir):
    return statistics.server_metrics(
        table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("latency_seconds"), (F.col("event_type") == "error").alias("is_error"), (1 + F.col("event_id") % 32).alias("batch_size"))
    )


@query(f"with {SERVER} select requests, errors, round(avg_latency, 9) as avg_latency, round(avg_batch, 9) as avg_batch from m")
def server_metrics(spark, sf_dir):
    return served(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("avg_latency", "avg_batch")})


@query(rf"""with {SERVER}
select printf('# HELP rank_requests_total Requests so far.' || chr(10) || '# TYPE rank_requests_total counter' || chr(10) || 'rank_requests_total %d' || chr(10) ||
  '# HELP rank_errors_total Errors so far.' || chr(10) || '# TYPE rank_errors_total counter' || chr(10) || 'rank_errors_total %d' || chr(10) ||
  '# HELP rank_latency_seconds Mean latency of a request.' || chr(10) || '# TYPE rank_latency_seconds gauge' || chr(10) || 'rank_latency_seconds %.6f' || chr(10) ||
  '# HELP rank_batch_size Mean size of a batch.' || chr(10) || '# TYPE rank_batch_size gauge' || chr(10) || 'rank_batch_size %.2f' || chr(10) ||
  '# HELP rank_uptime_seconds Time since the start.' || chr(10) || '# TYPE rank_uptime_seconds gauge' || chr(10) || 'rank_uptime_seconds 0.00' || chr(10), requests, errors, avg_latency, avg_batch) as body from m""")
def prometheus_text(spark, sf_dir):
    return statistics.exposition(served(spark, sf_dir), "rank")


@query("""with d as (select event_type, user_id % 8 as device_id, count(*) as in_flight, (user_id % 8) % 3 <> 0 as healthy from events group by all)
select event_type, arg_min(device_id, (in_flight, device_id)) as device_id from d where healthy group by event_type""")
def least_loaded(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 8).alias("device_id")).agg(F.count(F.lit(1)).alias("in_flight"))
    return statistics.least_loaded(e.withColumn("healthy", F.col("device_id") % 3 != 0), ["event_type"])


# --- routing ---


@query(f"with {VARIANTS} select event_id, variant from v")
def ab_route_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.hash_variant(F.col("user_id"), 70, 30).alias("variant"))


@query(f"with {REQUESTS} select event_id, case when (n - 1) % 10 < 7 then 'a' else 'b' end as variant from requests")
def ab_route_rr(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", C.counter_variant(F.col("n") - 1, 7, 3).alias("variant"))


@query(f"with {REQUESTS} select event_id, n % 100 < 25 as canary from requests")
def canary_route(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", C.canary_routed(F.col("n"), F.lit(25), F.lit(True)).alias("canary"))


@query(f"""with {REQUESTS},
configs as (
  select model, ts as since, cast(50 + n % 50 as bigint) as a, cast(n % 50 as bigint) as b, case when n % 600 = 500 then 'b' end as retain from requests where n % 100 = 0
),
met as (
  select r.event_id, r.user_id, case when c.retain is null then c.a else 0 end as a, case when c.retain is null then c.b else 1 end as b, c.model is not null as found, c.retain is null as active
  from requests r asof left join configs c on r.model = c.model and r.ts >= c.since
)
select event_id, found and active as active, case when not found then null when {bucket('user_id', 2**31)} % (a + b) < a then 'a' else 'b' end as variant from met""")
def ab_lifecycle(spark, sf_dir):
    asked = requests(spark, sf_dir).select("model", F.col("ts").alias("at"), "event_id", "user_id", "n")
    stopped = F.when(F.col("n") % 600 == 500, "b")
    configs = asked.where("n % 100 = 0").select("model", "at", (50 + F.col("n") % 50).alias("weight_a"), (F.col("n") % 50).alias("weight_b"), stopped.alias("retain"))
    found = experiment.configured(asked, configs, ("model",))
    config = F.col("config")
    return found.select("event_id", F.coalesce(config["active"], F.lit(False)).alias("active"), experiment.variant(F.col("user_id"), config).alias("variant"))


@query(f"""with recursive {REQUESTS},
ticks as (
  select model, n as tick, epoch_ms(ts) / 1000.0::double as t0, case when value > 150 and event_id % 5 = 0 then 'Warning' else 'Stable' end as drift, value < 250 as ok from requests
),
course(model, tick, action, state, stage, since) as (
  select model, 0::bigint, '', '', 0, 0.0::double from (select distinct model from ticks)
  union all
  select model, tick, action, case action when 'Rollback' then 'RollingBack' when 'Complete' then 'Completed' else state end,
    case when action like 'Advance%' or action = 'Complete' then stage + 1 else stage end, case when action like 'Advance%' then t0 else since end
  from (
    select *, case when state <> 'Active' then 'None' when drift = 'Warning' or not ok then 'Rollback' when t0 - since < 3600 then 'None' when stage + 1 >= 4 then 'Complete'
      else 'Advance(' || [1, 5, 25, 100][stage + 2] || ')' end as action
    from (select t.model, t.tick, t.t0, t.drift, t.ok, case c.state when '' then 'Active' else c.state end as state, c.stage, case c.state when '' then t.t0 else c.since end as since
      from course c join ticks t on t.model = c.model and t.tick = c.tick + 1)
  )
)
select model as canary, tick, action, state, stage, cast(case when state = 'Active' then [1, 5, 25, 100][stage + 1] else 0 end as integer) as percent from course where tick > 0""")
def canary_fold(spark, sf_dir):
    late = (F.col("value") > 150) & (F.col("event_id") % 5 == 0)
    ticks = requests(spark, sf_dir).select(
        F.col("model").alias("canary"),
        F.col("n").cast("long").alias("tick"),
        (F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)") / 1000.0).alias("at"),
        F.when(late, "Warning").otherwise("Stable").alias("drift"),
        (F.col("value") < 250).alias("latency_ok"),
        F.lit(None).cast("string").alias("command"),
    )
    return rollout.canary_course(ticks, CanaryConfig(observation_seconds=3600.0))


@query(f"""with recursive {REQUESTS},
arrivals as (select model, n, event_id, epoch_ms(ts) / 1000.0::double as at from requests),
course(model, n, event_id, batch_id, opened, place) as (
  select model, 0::bigint, -1::bigint, -1::bigint, -1e18::double, 8 from (select distinct model from arrivals)
  union all
  select a.model, a.n, a.event_id, case when fresh then batch_id + 1 else batch_id end, case when fresh then a.at else opened end, case when fresh then 0 else place + 1 end
  from (select c.model, c.batch_id, c.opened, c.place, x.n, x.event_id, x.at, c.place + 1 >= 8 or x.at - c.opened > 7200 as fresh from course c join arrivals x on x.model = c.model and x.n = c.n + 1) a
)
select model as stream, event_id as request_id, batch_id, place from course where n > 0""")
def batch_assign(spark, sf_dir):
    arrivals = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("request_id"), (F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)") / 1000.0).alias("at"))
    return rollout.batches(arrivals, BatchConfig(8, 7200.0))


# --- drift ---

DRIFT = DriftConfig(threshold=0.4, warm_up=200)
EVERY = 100
BINNED = f"""{REQUESTS}, binned as (
  select model, n, cast(least(floor(greatest(0::float, least(1::float, (value / 100)::float)) * 100::float), 99) as integer) as bin from requests
)"""
CHECKED = f"""{BINNED},
spans as (select model, (n + 99) // 100 as chk, bin, sum(pow(0.99::double, ((n + 99) // 100) * 100 - n)) as w from binned group by all),
ended as (select model, max(n) as last from binned group by model),
cur as (
  select s.model, c.chk, s.bin, sum(s.w * pow(0.99::double, (c.chk - s.chk) * 100)) as w
  from spans s join (select distinct model, chk from spans) c on c.model = s.model and c.chk >= s.chk and c.chk - s.chk <= 42 join ended e on e.model = s.model and c.chk * 100 <= last
  group by all
),
base as (select model, bin, sum(pow(0.99::double, 200 - n)) as w from binned where n <= 200 group by all),
p as (
  select model, chk, bin, coalesce(w, 0) / sum(w) over (partition by model, chk) as p
  from (select * from (select distinct model, chk from cur), (select unnest(range(100)) as bin)) left join cur using (model, chk, bin)
),
q as (
  select model, bin, coalesce(w, 0) / sum(w) over (partition by model) as q
  from (select * from (select distinct model from base), (select unnest(range(100)) as bin)) left join base using (model, bin)
),
kls as (select model, chk * 100 as n, sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))) as kl from p join q using (model, bin) group by model, chk)"""


def scores(spark, sf_dir):
    return requests(spark, sf_dir).select("model", "n", (F.col("value") / 100).cast("float").alias("score"))


@query(f"with {BINNED} select model, bin, round(sum(pow(0.99::double, last - n)), 9) as weight from binned join (select model, max(n) as last from binned group by model) using (model) group by model, bin")
def drift_histogram(spark, sf_dir):
    return drift.histogram(scores(spark, sf_dir), DRIFT).withColumn("weight", F.round("weight", 9))


@query(f"with {CHECKED} select model, n, round(kl, 6) as kl from kls where n >= 200")
def drift_kl(spark, sf_dir):
    found = drift.checks(scores(spark, sf_dir), EVERY, DRIFT).where("kl is not null")
    return found.select("model", "n", F.round("kl", 6).alias("kl"))


@query(f"""with {CHECKED},
over_ as (select *, n >= 200 as known, n >= 200 and kl > 0.4 as over from kls),
runs as (select *, sum(case when known and not over then 1 else 0 end) over (partition by model order by n) as run from over_),
alerts as (select *, sum(over::integer) over (partition by model, run order by n) as alerts from runs)
select model, n, case when known then round(kl, 6) end as kl,
  case when not known then 'InsufficientData' when over then case when alerts >= 5 then 'Critical' else 'Warning' end
    when coalesce(lag(alerts) over (partition by model order by n), 0) > 0 then 'Recovered' else 'Stable' end as status, cast(alerts as integer) as alerts
from alerts""")
def drift_status(spark, sf_dir):
    return drift.checks(scores(spark, sf_dir), EVERY, DRIFT).withColumn("kl", F.round("kl", 6))
