"""Quality rules: base figures of a text, and lines that too many documents of a host share.

Only DataFrame and SQL functions. Each text is parsed once, into its figures and the hashes of its normalised
lines; that narrow table is written to the shared folder, and what follows reads it. Copies of a text on a host are
counted as one document before lines are dealt out, so neither a large group of copies nor a host with a third of all
rows makes a large task: lines are counted by (host, line) with partial sums first, and near copies are looked for and distinct
documents counted only among texts with lines that have passed the limit by plain occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import NOT_SPACE, SPACE, let, materialised, packed_row, small, text_of, unpacked
from rankloom.llm.components import components


@dataclass(frozen=True)
class Limits:
    """``docs``, ``share``: a line goes if more distinct documents of its host have it than ``docs`` and than ``share`` of the
    host's distinct documents. Texts are one document if they are copies, or near copies: by lines and by words, two share ``alike`` of all that
    either has. ``left``: a document is depleted if less than this share of its words is left."""

    docs: int = 10
    share: float = 0.001
    alike: float = 0.9
    left: float = 0.2
    min_words: int = 20
    max_repeat_percent: int = 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 8) -> Column:
    """How many words lie in windows of ``width`` words, a power of two, that occur twice or more in the array."""

    def doubled(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    def hashes(h: Column, step: int) -> Column:
        return h if step == width else let(doubled(h, step), lambda x: hashes(x, 2 * step))

    def spread(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))

        starts = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        gaps = let(starts, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def counted(w: Column) -> Column:
        windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: hashes(h, 1))
        kept = let(windows, lambda h: F.slice(h, F.lit(1), F.size(h) - (width - 1)))
        return let(kept, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spread(h)))

    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(words, counted)).cast("long")


def normalised(line: Column) -> Column:
    """Small letters, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " "))


def figures(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep``, the base figures of each text, and ``lines``: for each line with a word, its hash and number of words."""
    text = text_of(text_col)
    parsed = docs.select(
        *keep,
        F.xxhash64(text).alias("ta"),
        F.xxhash64(F.lit("second"), text).alias("tb"),
        words_of(text).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("spoken"),
    )
    line = lambda x: let(normalised(x), lambda y: F.struct(F.xxhash64(y).alias("h"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n")))
    names = [c for c in parsed.columns if c not in ("words", "spoken")]
    return parsed.select(
        *names,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("spoken", line).alias("lines"),
    )


def copies(texts: DataFrame, limits: Limits) -> DataFrame:
    """``key, root``: texts of a host that are near copies of another one, and for each group of them one key that stands for it.

    ``texts`` has ``host, key, lines`` (distinct ones) and ``own``, how many of these lines few documents have. Bands of min-hashes over
    all lines say which texts may be near copies. Each is compared with the text of its band that has the fewest lines of its own, the likely
    original, so a large group costs as many comparisons as it has texts. At a likeness of 0.9 a pair shares no band with probability 1e-7.
    """
    mins = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.array_min(F.transform("lines", lambda x: F.xxhash64(x["h"], i))))
    bands = let(mins, lambda m: F.array(*(F.xxhash64(F.lit(b), m[3 * b], m[3 * b + 1], m[3 * b + 2]) for b in range(12))))
    dealt = materialised(texts.select("host", "key", "own", F.explode(bands).alias("band")), "bands")
    heads = dealt.groupBy("host", "band").agg(F.min(F.struct("own", "key")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = materialised(heads.select(F.col("host").alias("_host"), F.col("band").alias("_band"), F.col("head.key").alias("head")), "heads")
    met = dealt.join(heads, dealt["host"].eqNullSafe(heads["_host"]) & (F.col("band") == F.col("_band"))).where("key <> head")
    pairs = materialised(met.select("key", "head").distinct(), "pairs")
    one, other = texts.select("key", F.col("lines").alias("a")), texts.select(F.col("key").alias("head"), F.col("lines").alias("b"))
    words = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, y: acc + y["n"])
    sizes = pairs.join(one, "key").join(other, "head").select("key", "head", "a", "b", F.array_intersect("a", "b").alias("c"))
    alike = lambda size: size(F.col("c")) >= limits.alike * (size(F.col("a")) + size(F.col("b")) - size(F.col("c")))
    found = sizes.where(alike(F.size) & alike(words)).select(F.col("key").alias("u"), F.col("head").alias("v"))
    return components(found).select(F.col("node").alias("key"), "root")


def common_lines(texts: DataFrame, limits: Limits) -> DataFrame:
    """``host, h``: the lines above the limits. ``texts`` has a row ``host, ta, tb, lines`` for each distinct text of a host."""
    texts = texts.select("host", F.xxhash64("host", "ta", "tb").alias("key"), F.array_distinct("lines").alias("lines"))
    uses = texts.select("host", "key", F.explode("lines.h").alias("h"))
    often = uses.groupBy("host", "h").count().where(F.col("count") > limits.docs).select("host", "h")
    often = materialised(often, "often")
    near = uses.join(small(often), (uses["host"].eqNullSafe(often["host"])) & (uses["h"] == often["h"]), "left_semi")
    near = materialised(near, "near")
    shared = near.groupBy("key").agg(F.count(F.lit(1)).alias("shared"))
    carriers = materialised(texts.join(shared, "key").select("host", "key", "lines", (F.size("lines") - F.col("shared")).alias("own")), "carriers")
    groups = materialised(copies(carriers, limits), "copies").withColumnRenamed("key", "_key")
    groups = small(groups)
    grouped = near.join(groups, near["key"] == F.col("_key"), "left").select("host", "h", F.coalesce("root", "key").alias("one"))
    counted = grouped.groupBy("host", "h").agg(F.count_distinct("one").alias("n"))
    all_, spare = texts.groupBy("host").agg(F.count(F.lit(1)).alias("texts")), carriers.join(groups, carriers["key"] == F.col("_key")).where("key <> root").groupBy("host").agg(F.count(F.lit(1)).alias("spare"))
    spare = spare.withColumnRenamed("host", "_host")
    hosts = all_.join(spare, all_["host"].eqNullSafe(spare["_host"]), "left").select("host", (F.col("texts") - F.coalesce("spare", F.lit(0))).alias("docs"))
    hosts = small(materialised(hosts, "hosts"))
    joined = counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).select(counted["*"], "docs")
    return joined.where(F.col("n") > F.greatest(F.lit(float(limits.docs)), F.col("docs") * limits.share)).select("host", "h")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """A row per row of ``docs``: id, host, key of the text (``ta, tb``), figures, ``gone_words`` and ``gone`` (hashes of its
    lines above the limits), ``base_failed``, ``kept``.

    Words are runs of characters other than space and U+0009 to U+000D. A null text is an empty one, which fails the base
    rules for having no words; a null host is a host of its own. Repeated rows get equal rows; an empty table gives none;
    columns other than the three named are not looked at.
    """
    base = materialised(figures(docs, text_col, F.col(id_col).alias("id"), F.col(host_col).alias("host")), "figures")
    texts = base.where(F.size("lines") > 0).groupBy("host", "ta", "tb").agg(F.any_value("lines").alias("lines"))
    common = materialised(common_lines(texts, limits), "common")
    rows = texts.select("host", "ta", "tb", F.explode("lines").alias("line"))
    hit = rows.join(small(common), rows["host"].eqNullSafe(common["host"]) & (F.col("line.h") == common["h"])).select(rows["host"], "ta", "tb", "line")
    gone = hit.groupBy("host", "ta", "tb").agg(F.sum("line.n").alias("gone_words"), F.collect_set("line.h").alias("gone"))
    gone = gone.withColumnsRenamed({"host": "_host", "ta": "_ta", "tb": "_tb"})
    out = base.join(gone, base["host"].eqNullSafe(gone["_host"]) & (base["ta"] == gone["_ta"]) & (base["tb"] == gone["_tb"]), "left")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "ta",
        "tb",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.coalesce("gone_words", F.lit(0)).alias("gone_words"),
        "gone",
        failed.alias("base_failed"),
        (~failed & (left >= F.col("n_words") * limits.left)).alias("kept"),
    )


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes ``gone`` lists."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(NOT_SPACE) & F.array_contains(gone, F.xxhash64(normalised(x)))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def filtered(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The kept rows of ``documents``, all columns, without the lines above the limits; ``n_chars`` follows the text.

    Rows are matched to their verdicts by host, text and id, so repeated rows share a fate.
    """
    verdicts = judged(docs, limits=limits)
    keys = verdicts.where("kept").select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("ta").alias("_ta"), F.col("tb").alias("_tb"), "gone")
    keys = small(materialised(keys.dropDuplicates(["_id", "_host", "_ta", "_tb"]), "kept"))
    rows = docs.select(packed_row(docs, "text"), "doc_id", "source", "text")
    text = text_of("text")
    on = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_host"))
        & (F.xxhash64(text) == F.col("_ta"))
        & (F.xxhash64(F.lit("second"), text) == F.col("_tb"))
    )
    out = rows.join(keys, on).withColumn("text", without_lines(F.col("text"), F.col("gone")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(unpacked(docs, changed))
