import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom import config, errors
from rankloom.functions import columns as C
from rankloom.functions import names


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,expected", [(0.0, 0.5), (float("inf"), 1.0), (float("-inf"), 0.0)])
def test_sigmoid(spark, x, expected):
    assert value(spark, C.sigmoid(F.lit(x))) == expected


def test_sigmoid_of_nan_and_order(spark):
    assert math.isnan(value(spark, C.sigmoid(F.lit(float("nan")))))
    xs = [r["y"] for r in spark.createDataFrame([(float(i),) for i in range(-30, 31)], "x double").select(C.sigmoid(F.col("x")).alias("y")).collect()]
    assert xs == sorted(xs) and all(0 < x < 1 for x in xs)


def test_platt(spark):
    assert value(spark, C.platt(F.lit(0.0), -1.0, 0.0)) == 0.5


VECTORS = [
    ([1.0, 0.0], [1.0, 0.0], 1.0),
    ([1.0, 0.0], [0.0, 1.0], 0.0),
    ([1.0, 0.0], [-1.0, 0.0], -1.0),
    ([0.0, 0.0], [1.0, 0.0], 0.0),
    ([0.0], [0.0], 0.0),
    ([2.0], [-3.0], -1.0),
    ([3.0, 4.0], [1.0], 3.0 / 5.0),
]


@pytest.mark.parametrize("a,b,expected", VECTORS)
def test_cosine(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(C.cosine(F.col("a"), F.col("b")).alias("x"), C.cosine(F.col("b"), F.col("a")).alias("y")).first()
    assert row["x"] == pytest.approx(expected) and row["y"] == pytest.approx(expected)


def test_maxsim(spark):
    kind = "q array<array<double>>, d array<array<double>>"
    rows = [
        ([[1.0, 0, 0], [0, 1.0, 0]], [[1.0, 0, 0], [0, 0, 1.0], [0, 0.5, 0.5]]),
        ([[1.0, 0]], []),
        ([[1.0, 0], [0, 1.0]], [[1.0, 0], [0, 1.0]]),
        ([[1.0, 0]], [[float("nan"), 0], [0.0, 1.0]]),
    ]
    found = [r["x"] for r in spark.createDataFrame([tuple([[float(x) for x in v] for v in side] for side in row) for row in rows], kind).coalesce(1).select(C.maxsim(F.col("q"), F.col("d")).alias("x")).collect()]
    assert found == pytest.approx([1 + 0.5 / math.sqrt(0.5), 0.0, 2.0, 0.0])


@pytest.mark.parametrize("x,bin_", [(-0.5, 0), (1.5, 99), (0.29, 29), (1.0, 99), (float("nan"), 0), (0.999, 99)])
def test_histogram_bin(spark, x, bin_):
    assert value(spark, C.histogram_bin(F.lit(x).cast("float"))) == bin_


def test_variants(spark):
    rows = spark.range(1000).select(C.counter_variant(F.col("id"), 70, 30).alias("c"), C.hash_variant(F.col("id"), 70, 30).alias("h"), C.hash_variant(F.lit("x"), 70, 30).alias("same"))
    found = rows.agg(F.count_if(F.col("c") == "a"), F.count_if(F.col("h") == "a"), F.count_distinct("same")).first()
    assert found[0] == 700 and abs(found[1] - 700) < 50 and found[2] == 1
    assert value(spark, C.hash_variant(F.lit("x"), 0, 0)) == "a"
    assert value(spark, C.hash_variant(F.lit("x"), 0, 100)) == "b"
    assert value(spark, C.hash_variant(F.lit("x"), 100, 0)) == "a"


def test_canary_routed(spark):
    rows = spark.range(1, 201).select(C.canary_routed(F.col("id"), F.lit(50), F.lit(True)).alias("c"))
    assert rows.where("c").count() == 100
    assert not value(spark, C.canary_routed(F.lit(1), F.lit(50), F.lit(False)))
    assert value(spark, C.canary_routed(F.lit(1), F.lit(100), F.lit(True)))
    assert not value(spark, C.canary_routed(F.lit(1), F.lit(0), F.lit(True)))


def test_small_parsers(spark):
    assert value(spark, C.integers(F.lit("0, 2,x,3 ,"))) == [0, 2, 3]
    grades = spark.createDataFrame([("2",), ("abc",), ("-1",), ("256",), (" 3",)], "s string").coalesce(1).select(C.graded(F.col("s")).alias("g"))
    assert [r["g"] for r in grades.collect()] == [2, 0, 0, 0, 3]
    assert value(spark, C.titled(F.lit("Gravity"), F.lit("pulls"))) == "Gravity pulls"
    assert value(spark, C.titled(F.lit(""), F.lit("pulls"))) == "pulls"
    assert value(spark, C.titled(F.lit(None).cast("string"), F.lit("pulls"))) == "pulls"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3), st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3))
def test_cosine_is_bounded_and_symmetric(spark, a, b):
    x = F.array(*map(F.lit, a)), F.array(*map(F.lit, b))
    row = spark.range(1).select(C.cosine(*x).alias("x"), C.cosine(*x[::-1]).alias("y")).first()
    assert -1 - 1e-9 <= row["x"] <= 1 + 1e-9 and row["x"] == pytest.approx(row["y"])


def test_devices_and_precisions():
    assert names.parse_device("cpu") == config.Device("cpu")
    assert names.parse_device("cuda") == config.Device("cuda", 0)
    assert names.parse_device("cuda:1") == config.Device("cuda", 1)
    assert names.parse_device("tensorrt:x") == config.Device("tensorrt", 0)
    for bad in ("cuda:x", "tpu", ""):
        with pytest.raises(errors.ConfigError):
            names.parse_device(bad)
    assert names.parse_precision("int8") == "INT8"
    with pytest.raises(errors.ConfigError):
        names.parse_precision("INT8")
    assert names.effective_precision("INT8", False) == "FP16"
    assert names.effective_precision("INT8", True) == "INT8"
    assert names.effective_precision("FP32", False) == "FP32"
    assert names.engine_name("sm89", "INT8", "10.0") == "sm89-int8-trt10.0.engine"
    assert names.epoch_text(5) == "5s since epoch"


def test_cache_root():
    assert str(names.cache_root({"HF_HOME": "/h"})) == "/h/hub"
    assert str(names.cache_root({"HOME": "/u"})) == "/u/.cache/huggingface/hub"
    assert str(names.cache_root({})) == ".cache/huggingface/hub"


def test_configs_and_errors():
    assert config.FusionConfig() == config.FusionConfig(60.0, (1.0,))
    assert config.RerankConfig() == config.RerankConfig(64, 512, True)
    assert config.ModelConfig().max_length == 128
    for low, high in ((0.7, 0.3), (0.5, 0.5)):
        with pytest.raises(errors.ConfigError):
            config.CascadeConfig(high=high, low=low)
    assert str(errors.CacheError("x")) == "cache error: x"
    assert issubclass(errors.CalibrationError, errors.RankError)
