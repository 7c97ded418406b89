"""Column expressions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x): 1 and 0 at the infinities, NaN for NaN."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def platt(x: Column, a: float, b: float) -> Column:
    """1 / (1 + e^(a x + b))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(x.cast("double") * a + b))


def at_least(x: Column, bound: float) -> Column:
    """``x >= bound`` where NaN is not, compared as 32-bit floats."""
    return F.coalesce(~F.isnan(x) & (x.cast("float") >= F.lit(bound).cast("float")), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine: the product over the shorter length, by the norms over all of each; 0 if either norm is."""
    return cosine_of(a, b, norm(a), norm(b))


def cosine_of(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """``cosine`` where the norms are at hand."""
    by = norm_a * norm_b
    return F.when(by == 0, F.lit(0.0)).otherwise(dot(a, b) / by)


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over the query's token vectors of the largest finite cosine with a token of the document; no such token adds nothing."""
    fine = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    best = lambda q: F.array_max(F.filter(F.transform(doc, lambda d: cosine(q, d)), fine))
    return F.aggregate(F.transform(query, best), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def histogram_bin(score: Column, bins: int = 100) -> Column:
    """The bin of a score cut to [0, 1], by a product of 32-bit floats; NaN goes to the first."""
    cut = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), score.cast("float")))
    of_number = F.least(F.floor(cut * F.lit(float(bins)).cast("float")).cast("int"), F.lit(bins - 1))
    return F.when(F.isnan(score) | score.isNull(), F.lit(0)).otherwise(of_number)


def md5_bucket(key: Column, buckets: int) -> Column:
    """A bucket from the first 32 bits of the key's MD5, the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_variant(key: Column, a: int, b: int) -> Column:
    """``a`` or ``b`` in the proportion of the weights, always the same for a key; ``a`` if both weigh nothing."""
    return F.lit("a") if a + b == 0 else F.when(md5_bucket(key, a + b) < a, "a").otherwise("b")


def counter_variant(ordinal: Column, a: int, b: int) -> Column:
    """By a 0-based ordinal: of each ``a + b`` in a row, the first ``a`` go to ``a``."""
    return F.lit("a") if a + b == 0 else F.when(F.pmod(ordinal, F.lit(a + b)) < a, "a").otherwise("b")


def canary_routed(ordinal: Column, percent: Column, active: Column) -> Column:
    """By a 1-based ordinal: whether a request goes to the canary, which takes ``percent`` of each hundred."""
    part = F.pmod(ordinal, F.lit(100)) < percent
    return F.when(~active | (percent <= 0), False).when(percent >= 100, True).otherwise(part)


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, in small letters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def all_tokens(text: Column) -> Column:
    """``tokens`` with repetitions."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def titled(title: Column, text: Column) -> Column:
    """Title and text with a blank between; the text alone if there is no title."""
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat_ws(" ", title, text))


def integers(listed: Column) -> Column:
    """The integers of a comma-separated list; other entries are dropped."""
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def graded(score: Column) -> Column:
    """A relevance of 0 to 255 from text; anything else is 0."""
    number = F.trim(score).try_cast("int")
    return F.when(number.between(0, 255), number).otherwise(0).cast("smallint")


def rotating(ordinal: Column, n: int) -> Column:
    """A 0-based index that walks through ``n`` places again and again."""
    return F.pmod(ordinal, F.lit(n))
