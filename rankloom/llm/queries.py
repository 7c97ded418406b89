"""The queries over the test tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import ann, byte_bpe, chat_format, line_dedup, ngram_join, packing, quality_rules, token_rollup, toxicity, url_filter
from rankloom.llm.common import materialised, text_of, work_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation of two turns, both made of other templates' control strings.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    events = chat_format.events_from_turns(turns.unionByName(probe))
    return chat_format.read_back(chat_format.format_conversations(events, ("turn", "tie")))


OP1_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
  select *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE|SEP)\])', '\1\\\2\3', 'g')) as chars,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE|SEP)\])', '\1\\\2\3', 'g')) as role_chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 11 else 18 + role_chars end) as bigint) as formatted_chars
from escaped group by conv_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text from documents
), words as (
  select rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w : w <> '') as w from docs
), windows as (
  select rid, i, array_to_string(w[i:i+7], ' ') as g from (select rid, w, unnest(range(1, len(w) - 6)) as i from words)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from windows) where c > 1
), repeats as (
  select rid, sum(least(8, coalesce(nxt - i, 8))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from twice) group by rid
), spoken as (
  select rid, list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) as s from docs
), figures as (
  select rid, doc_id, host, text, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(s) - len(list_distinct(s)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, s
  from docs join words using (rid) join spoken using (rid) left join repeats using (rid)
), texts as (
  select host, text, any_value(list_transform(s, lambda x : trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')))) as lines
  from figures where len(s) > 0 group by host, text
), hosts as (
  select host, count(*) as docs from texts group by host
), lines as (
  select host, text, lines, unnest(lines) as line from texts
), common as (
  select l.host, l.line from (
    select host, line, count(distinct text) as n, list_sort([count(distinct lines[1]), count(distinct lines[1 + (len(lines) - 1) // 4]), count(distinct lines[1 + (len(lines) - 1) * 2 // 4]),
      count(distinct lines[1 + (len(lines) - 1) * 3 // 4]), count(distinct lines[len(lines)])])[3] as rest
    from lines group by host, line
  ) l join hosts h on l.host is not distinct from h.host
  where n > greatest(10.0, docs * 0.001) and rest >= n * 0.5
), gone as (
  select l.host, l.text, sum(len(string_split(l.line, ' '))) as n
  from lines l join common c on l.host is not distinct from c.host and l.line = c.line group by l.host, l.text
), verdicts as (
  select f.*, coalesce(g.n, 0) as gone, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
  from figures f left join gone g on f.host is not distinct from g.host and f.text = g.text
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and n_words - gone >= n_words * 0.2 as kept
from verdicts
"""

#: The five given rules, and a list for what no rule of a site decides.
URL_RULES = [
    url_filter.site_rule("block", "com", "/en/"),
    url_filter.site_rule("allow", "example.com", "/en/7"),
    url_filter.site_rule("block", "net", "/de/"),
    url_filter.site_rule("block", "example.net", "/de/8"),
    url_filter.site_rule("block", "org", "/es/"),
    *url_filter.own_rules(),
]


def listed(action: str) -> str:
    """The list's rules of one action as one expression for SQL."""

    def one(line: str) -> str:
        text = line.removeprefix("@@")
        begin = r"^([^/]*\.)?" if text.startswith("||") else "^" if text.startswith("|") else ""
        body = re.sub(r"[.+?(){}\[\]\\]", r"\\\g<0>", text.strip("|"))
        if body.startswith("^") and not begin:
            begin, body = r"(^|[^A-Za-z0-9_%])", body[1:]
        return begin + body.replace("*", "(?s:.*)").replace("^", r"([^A-Za-z0-9_.%\-]|$)") + ("$" if text.endswith("|") else "")

    return "|".join(one(r.name) for r in url_filter.own_rules() if r.action == action)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = rf"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/]*((?s:/.*)?)', 1), '') as path
  from parts
), rules(action, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best as (
  select s.page_id, s.host, s.path, max_by(struct_pack(r := rhost || rpath, a := action), length(rhost || rpath)) as hit
  from (select distinct * from split) s join rules on (s.host = rhost or ends_with(s.host, '.' || rhost)) and starts_with(s.path, rpath)
  group by s.page_id, s.host, s.path
)
select s.page_id, s.host, s.path, hit.r as rule,
  coalesce(hit.a, case when regexp_matches(s.host || s.path, '{listed("allow")}') then 'allow' when regexp_matches(s.host || s.path, '{listed("block")}') then 'block' else 'allow' end) as verdict
from split s left join best b on s.page_id is not distinct from b.page_id and s.host = b.host and s.path = b.path
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP2_SQL = r"""
with recursive docs as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') as w from documents
), shingles as (
  select distinct rid, array_to_string(w[i:i+4], ' ') as g from (select rid, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0)
), sizes as (
  select rid, count(*) as n from shingles group by rid
), shared as (
  select a.rid as x, b.rid as y, count(*) as n from shingles a join shingles b on a.g = b.g and a.rid < b.rid group by a.rid, b.rid
), links as (
  select x, y from shared join sizes p on p.rid = x join sizes q on q.rid = y where 5 * shared.n >= 4 * (p.n + q.n - shared.n)
), both_ways as (
  select x, y from links union all select y, x from links
), reach(x, y) as (
  select rid, rid from docs union select r.x, b.y from reach r join both_ways b on r.y = b.x
), classes as (
  select r.x as rid, min(d.doc_id) as class_id from reach r join docs d on d.rid = r.y group by r.x
), counted as (
  select x as rid, count(*) as n_links from both_ways group by x
)
select doc_id, class_id, coalesce(n_links, 0) as n_links from docs join classes using (rid) left join counted using (rid)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(read(spark, sf_dir, "documents"), least=50).select("doc_id", "text", "n_lines", "n_deleted")


OP7_SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents
), parts as (
  select rid, doc_id, unnest(parts) as raw, unnest(range(len(parts))) as pos from docs
), spoken as (
  select rid, doc_id, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line,
    row_number() over (partition by rid order by pos) - 1 as p
  from parts where regexp_matches(raw, '[^\x20\x09-\x0D]')
), counted as (
  select *, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) as n from spoken
), sums as (
  select *, sum(n) over (partition by rid order by p) as upto from counted
), begins as (
  select a.rid, a.doc_id, a.p as i, min(b.p) - a.p + 1 as m from sums a join sums b on a.rid = b.rid and b.p >= a.p and b.upto - a.upto + a.n >= 50 group by a.rid, a.doc_id, a.p
), ends as (
  select b.rid, b.doc_id, max(a.p) as i, b.p - max(a.p) + 1 as m from sums b join sums a on a.rid = b.rid and a.p <= b.p and b.upto - a.upto + a.n >= 50 group by b.rid, b.doc_id, b.p
), windows as (
  select rid, doc_id, i, m from begins union select rid, doc_id, i, m from ends
), keyed as (
  select w.rid, w.doc_id, w.i, w.m, string_agg(s.line, chr(10) order by s.p) as k from windows w join spoken s on s.rid = w.rid and s.p >= w.i and s.p < w.i + w.m group by w.rid, w.doc_id, w.i, w.m
), placed as (
  select *, row_number() over (partition by k order by doc_id nulls last, rid, i) as nth from keyed
), gone as (
  select distinct s.rid, s.pos from placed w join spoken s on s.rid = w.rid and s.p >= w.i and s.p < w.i + w.m where nth > 1
), tally as (
  select rid, count(*) as n_lines from spoken group by rid
), cut as (
  select rid, count(*) as n_deleted from gone group by rid
), rest as (
  select p.rid, string_agg(p.raw, chr(10) order by p.pos) as text from parts p anti join gone g on p.rid = g.rid and p.pos = g.pos where p.rid in (select rid from gone) group by p.rid
)
select d.doc_id, case when n_deleted is null then d.text when n_deleted = n_lines then '' else coalesce(r.text, '') end as text,
  coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted
from docs d left join tally using (rid) left join cut using (rid) left join rest r using (rid)
"""


#: The tokenizer versions that are counted, and their rank files.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def rolled_up(spark: SparkSession, docs: DataFrame, first: str, second: str, short: str) -> DataFrame:
    """Totals of ``docs`` (``id, source, lang`` and a count for each version) under two versions, after batches that cancel out or repeat.

    The second version's counts are those of the first until they are revised; the rows that ``short`` names are deleted and inserted
    again; the first batch comes twice under its name, once with its events repeated, and once more under another name.
    """

    def events(rows: DataFrame, second_count: str = second, suffix: str = "") -> DataFrame:
        made = [token_rollup.inserted(rows, F.concat_ws("/", "id", F.lit(v + suffix)), v, F.col(c)) for v, c in ((first, first), (second, second_count))]
        return made[0].unionByName(made[1])

    revised = docs.where(F.col(first) != F.col(second)).select(
        F.concat_ws("/", "id", F.lit(second)).alias("event_id"), F.lit("revise").alias("kind"), "source", "lang", F.lit(second).alias("version"), F.col(second).alias("tokens"), F.col(first).alias("prior")
    )
    gone = docs.where(short)
    rollup = token_rollup.Rollup(spark, f"{work_dir(spark)}/rollup-{uuid.uuid4().hex}")
    inserts = events(docs, first)
    rollup.commit("inserts", inserts)
    rollup.commit("revisions", revised)
    rollup.commit("inserts", inserts.unionByName(inserts))
    rollup.commit("deletes", events(gone).withColumn("kind", F.lit("delete")))
    rollup.compact()
    rollup.commit("again", inserts)
    rollup.commit("returns", events(gone, suffix="/2"))
    return rollup.totals()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all ``documents`` in ids of two byte-pair vocabularies. Each row is an insert of its own, numbered when its counts are
    written."""
    about = F.struct(F.monotonically_increasing_id().alias("id"), "source", "lang").alias("about")
    paths = {v: public_tokenizers.path(file) for v, file in VERSIONS.items()}
    rows = byte_bpe.counted(read(spark, sf_dir, "documents").select(about, "text"), paths, "about")
    docs = materialised(rows.select("about.*", *paths), "counts")
    return rolled_up(spark, docs, *paths, short="byte_bpe_50k < 10")


def op10_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op10_token_counts``, in words and in bytes, which SQL can count as well."""
    text = text_of("text")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words-1")
    docs = read(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("id"), "source", "lang", words, F.octet_length(text).cast("long").alias("bytes-1"))
    return rolled_up(spark, materialised(docs, "counts"), "words-1", "bytes-1", short="`words-1` < 3")


OP10_SQL = r"""
with counted as (
  select source, lang, coalesce(text, '') as text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '')) as words from documents
), versions as (
  select source, lang, 'words-1' as version, words as tokens from counted
  union all select source, lang, 'bytes-1', strlen(text) from counted
)
select source, lang, version, count(*) as docs, cast(sum(tokens) as bigint) as tokens from versions group by all
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chat_formatting,
        op2_ngram_join,
        op3_quality_rules,
        op4_byte_bpe,
        op5_url_filters,
        op6_best_fit_packing,
        op7_line_dedup,
        op8_nearest_neighbours,
        op9_toxicity,
        op10_token_counts,
        op10_word_totals,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL,
        "op2_ngram_join": OP2_SQL,
        "op3_quality_rules": OP3_SQL,
        "op5_url_filters": OP5_SQL,
        "op7_line_dedup": OP7_SQL,
        "op10_word_totals": OP10_SQL,
    }
