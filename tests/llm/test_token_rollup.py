import duckdb
import public_tokenizers
import pytest
import tiktoken
from llm_support import DOCUMENT, awkward
from pyspark.sql import functions as F
from support import same_rows

from rankloom.llm import byte_bpe, queries
from rankloom.llm import token_rollup as R

EVENT = "event_id string, kind string, source string, lang string, version string, tokens bigint, prior bigint"


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_batches(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    assert totals(rollup) == {}
    first = spark.createDataFrame(
        [("1", "insert", "a", "en", "v1", 10, None), ("2", "insert", "a", "en", "v1", 5, None), ("3", "insert", None, None, None, None, None), ("1", "insert", "a", "en", "v1", 10, None), ("4", "insert", "b", "en", "v1", 7, 0)],
        EVENT,
    )
    assert rollup.commit("b1", first)
    want = {("a", "en", "v1"): (2, 15), (None, None, None): (1, 0), ("b", "en", "v1"): (1, 7)}
    assert totals(rollup) == want
    assert not rollup.commit("b1", first.limit(1)) and totals(rollup) == want
    second = spark.createDataFrame([("1", "revise", "a", "en", "v1", 12, 10), ("4", "delete", "b", "en", "v1", 7, 0), ("3", "delete", None, None, None, None, None)], EVENT)
    assert rollup.commit("b2", second)
    assert totals(rollup) == {("a", "en", "v1"): (2, 17)}
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v1"): (2, 17)}
    assert not rollup.commit("b2", second)
    assert rollup.commit("b3", spark.createDataFrame([("9", "insert", "a", "en", "v1", 1, 0)], EVENT))
    rollup.compact()
    assert totals(R.Rollup(spark, f"file://{tmp_path}/roll")) == {("a", "en", "v1"): (3, 18)}


def test_a_commit_that_was_cut_short_counts_nothing(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    one = spark.createDataFrame([("1", "insert", "a", "en", "v1", 10, 0)], EVENT)
    rollup.commit("b1", one)
    (tmp_path / "roll" / "deltas" / "b1" / "_SUCCESS").unlink()
    assert totals(rollup) == {}
    assert rollup.commit("b1", one) and totals(rollup) == {("a", "en", "v1"): (1, 10)}
    rollup.compact()
    (tmp_path / "roll" / "base" / "1" / "_SUCCESS").unlink()
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_errors_and_nothing(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    with pytest.raises(Exception, match="unknown event kind"):
        rollup.commit("b1", spark.createDataFrame([("1", "shout", "a", "en", "v1", 1, 0)], EVENT))
    with pytest.raises(ValueError):
        rollup.commit("../b", spark.createDataFrame([], EVENT))
    assert rollup.commit("none", spark.createDataFrame([], EVENT)) and totals(rollup) == {}


def test_unnamed_events(spark):
    events = spark.createDataFrame([(None, "insert", "a", "en", "v1", 3, 0), (None, "insert", "a", "en", "v1", 4, 0), (None, "insert", "a", "en", "v1", 4, 0)], EVENT)
    assert tuple(R.deltas(events).first()) == ("a", "en", "v1", 2, 7)


def test_counts_of_a_byte_pair_vocabulary(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "hello world", "a", "en"), (2, "tokens", "a", "en"), (3, None, "b", "de")], "doc_id bigint, text string, source string, lang string")
    counted = docs.drop("text").join(byte_bpe.encoded(docs, path), "doc_id")
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    rollup.commit("b1", R.inserted(counted, F.col("doc_id").cast("string"), "byte_bpe_50k", F.size("ids")))
    codec = byte_bpe.codec(path)
    n = [len(x) for x in codec.encode(["hello world", "tokens"])]
    assert totals(rollup) == {("a", "en", "byte_bpe_50k"): (2, sum(n)), ("b", "de", "byte_bpe_50k"): (1, 0)}


def test_events_that_come_again_in_another_batch(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    one = spark.createDataFrame([("1", "insert", "a", "en", "v1", 10, 0), (None, "insert", "a", "en", "v1", 2, 0)], EVENT)
    both = one.unionByName(spark.createDataFrame([("2", "insert", "a", "en", "v1", 5, 0), ("1", "delete", "a", "en", "v1", 10, 0)], EVENT))
    assert rollup.commit("b1", one) and rollup.commit("b2", both)
    # the event without an id is a new one in each batch
    assert totals(rollup) == {("a", "en", "v1"): (3, 9)}
    rollup.compact()
    assert rollup.commit("b3", both.where("event_id is not null")) and totals(rollup) == {("a", "en", "v1"): (3, 9)}


def test_a_commit_while_a_base_is_made(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    event = lambda i, n: spark.createDataFrame([(i, "insert", "a", "en", "v1", n, 0)], EVENT)
    rollup.commit("b1", event("1", 10))
    sums = rollup._totals

    def late(base, batches):
        rollup._totals = sums
        rollup.commit("b2", event("2", 5))
        return sums(base, batches)

    rollup._totals = late
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v1"): (2, 15)}
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v1"): (2, 15)}


def test_two_bases_at_a_time_get_two_numbers(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    rollup.commit("b1", spark.createDataFrame([("1", "insert", "a", "en", "v1", 10, 0)], EVENT))
    assert rollup._claimed() != rollup._claimed()
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_other_columns_are_not_looked_at(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/roll")
    events = spark.createDataFrame([("1", "insert", "a", "en", "v1", 10, 0), ("1", "insert", "a", "en", "v1", 10, 0)], EVENT)
    clashing = events.withColumns({c: F.rand() for c in ("a", "b", "e", "_body", "docs", "batch")})
    assert rollup.commit("b1", clashing) and totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_registered_totals_hold_every_row_and_its_ids(spark, tmp_path):
    docs = awkward(spark).unionByName(awkward(spark).where("doc_id is null"))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    libraries = {v: tiktoken.Encoding(v, pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(f)), special_tokens={}) for v, f in queries.VERSIONS.items()}
    want = {}
    for r in docs.collect():
        for version, library in libraries.items():
            key = (r["source"], r["lang"], version)
            want[key] = tuple(map(sum, zip(want.get(key, (0, 0)), (1, len(library.encode_ordinary(r["text"] or ""))), strict=True)))
    got = queries.op10_token_counts(spark, f"file://{tmp_path}")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want


def test_ids_that_are_null_or_repeated_across_sources(spark, tmp_path):
    text = "four words of text"
    rows = [(None, text, "en", "a", 18), (None, text, "en", "b", 18), (None, text, None, "b", 18), (1, text, "en", "a", 18), (1, text, "de", "a", 18), (1, text, "en", None, 18), (2, "", "en", "a", 0), (2, None, "en", "a", 0)]
    spark.createDataFrame(rows, DOCUMENT).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op10_word_totals(spark, f"file://{tmp_path}").toPandas()
    base = duckdb.connect()
    base.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(got, base.execute(queries.OP10_SQL).df())
