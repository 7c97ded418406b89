"""Deletes later copies of repeated line runs.

The texts' lines are sequences of line ids, whose order is that of the lines' hashes. Their suffix array is built by prefix doubling:
at depth 1, 2, 4, ... suffixes that share so many lines with another one have the rank of their interval, which is the place of its first
suffix in the array of all that are left. One round pairs each suffix's rank with the rank a depth further on; the distinct pairs are
sorted over range partitions, and sums of their counts, within partitions and over them, are the new ranks. An interval of two or
more suffixes is one of a longest common prefix of at least the depth; suffixes alone in theirs drop out, so the rounds shrink. How
deep they must go depends on how many lines it takes to reach ``least`` words, not on how long the repeated runs are.

A run counts from ``least`` words on. All lines of all maximal repeated runs are covered by the shortest windows of that many
words, those that begin at a line and those that end at one: within a run, a line with enough words up to it ends such a window,
and any other line is in the one that begins with the run. So it is enough to find, for each such window, the interval of
suffixes with a common prefix of its length (two overlapping intervals of a power of two say which), and to take the window
if the interval's first suffix in corpus order is another one. Windows that overlap make up the maximal runs, which are deleted.

Copies of a whole text are counted once before any of this: a group of copies of any size is one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import SPACE, materialised, packed_row, small, small_batches, step, text_of, unpacked


#: Space and U+0009 to U+000D, one by one.
BLANKS = " \t\n\x0b\x0c\r"


def spoken_lines(text: Column) -> Column:
    """For each line with a word: two hashes of it, without spaces at its ends, and its number of words."""
    hashed = lambda y: F.struct(F.xxhash64(y).alias("a"), F.xxhash64(F.lit("second"), y).alias("b"), F.size(F.split(y, SPACE + "+")).alias("n"))
    return F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda y: y != ""), hashed)


def _windows(least: int):
    """For each text the shortest windows of ``least`` words that begin or end at a line: ``i`` the first line, ``m`` the number of lines."""

    def run(batches):
        for batch in batches:
            rows, first, size = [], [], []
            for r, counts in enumerate(batch.column(3).to_pylist()):
                sums = np.cumsum([0, *counts])
                if sums[-1] < least:
                    continue
                n = len(counts)
                end = np.searchsorted(sums, sums[:-1] + least)
                begin = np.searchsorted(sums, sums[1:] - least, side="right") - 1
                a, b = np.flatnonzero(end <= n), np.flatnonzero(sums[1:] >= least)
                pairs = np.unique(np.r_[np.c_[a, end[a] - a], np.c_[begin[b], b + 1 - begin[b]]], axis=0)
                rows.append(np.full(len(pairs), r))
                first.append(pairs[:, 0])
                size.append(pairs[:, 1])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(at) for i in range(3)), pa.array(np.concatenate(first), pa.int32()), pa.array(np.concatenate(size), pa.int32())], names=["no", "doc", "t", "i", "m"]
                )

    return run


def ranked(groups: DataFrame, by: list[str]) -> DataFrame:
    """``groups`` (a row for each distinct value of ``by``, with ``n``) with ``rank``: the sum of ``n`` over all smaller values."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)
    at = groups.columns.index("n")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(at).to_numpy()
            upto = np.cumsum(n) + before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - n, pa.int64()), pa.array(np.full(len(n), part, np.int32))], names=[*batch.schema.names, "rank", "part"])
            before = int(upto[-1]) if len(upto) else before

    rows = materialised(groups.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, f"{fields}, rank bigint, part int"), "ranked")
    # as many rows as partitions
    sizes = sorted((r["part"], r["size"]) for r in rows.groupBy("part").agg(F.sum("n").alias("size")).collect())
    before = np.cumsum([0, *(size for _, size in sizes)]).tolist()
    parts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part int, _before bigint")
    return rows.join(F.broadcast(parts), F.col("part") == F.col("_part")).select(*groups.columns, (F.col("rank") + F.col("_before")).alias("rank"))


def _named(suffixes: DataFrame, as_: str) -> DataFrame:
    return suffixes.select(*(F.col(c).alias(f"{as_}_{c}") for c in ("no", "doc", "t", "p")), F.col("rank").alias(as_))


def _at(as_: str, p: Column) -> Column:
    """The join of a window with the suffix at its text's line ``p``."""
    same = [F.col(f"{as_}_{c}").eqNullSafe(F.col(c)) for c in ("no", "doc", "t")]
    return same[0] & same[1] & same[2] & (F.col(f"{as_}_p") == p)


def later_copies(texts: DataFrame, least: int) -> DataFrame:
    """``no, doc, t, i, m``: windows of lines that are later copies. ``texts`` has ``no, doc, t, lines``, a row for each distinct text, in
    the order of ``no, doc, t``. Texts without lines or with too few words have no windows; no texts give none."""
    place = lambda p: F.struct("no", "doc", "t", F.col(p).cast("int").alias("p"))
    long = texts.where(F.aggregate("lines", F.lit(0), lambda n, x: n + x["n"]) >= least)
    windows = long.select("no", "doc", "t", F.transform("lines", lambda x: x["n"]).alias("counts")).mapInArrow(_windows(least), "no boolean, doc bigint, t bigint, i int, m int")
    windows = materialised(windows, "windows")
    deepest = windows.agg(F.max("m")).first()[0] or 0

    lines = long.select("no", "doc", "t", F.posexplode("lines").alias("p", "line")).select("no", "doc", "t", "p", "line.a", "line.b")
    names = ranked(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["a", "b"])
    # written first: the join then has no sum in its stage, and a line of very many texts is split like any skewed key
    names = small(materialised(names.select("a", "b", "rank"), "names"))
    active = materialised(lines.join(names, ["a", "b"]).select("no", "doc", "t", "p", "rank"), "suffixes")

    found, depth = [], 1
    while depth <= deepest:
        here = windows.where((F.col("m") >= depth) & (F.col("m") < 2 * depth))
        begin, end = _named(active, "x"), _named(active, "y")
        met = here.join(begin, _at("x", F.col("i"))).join(end, _at("y", F.col("i") + F.col("m") - depth))
        met = materialised(met.select("no", "doc", "t", "i", "m", "x", "y"), "met")
        first = met.groupBy("x", "y", "m").agg(F.min(place("i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        first = small(materialised(first, "first"))
        found.append(met.join(first, ["x", "y", "m"]).where(F.col("first") < place("i")).select("no", "doc", "t", "i", "m"))
        if 2 * depth <= deepest:
            order = Window.partitionBy("no", "doc", "t").orderBy("p").rangeBetween(depth, depth)
            pairs = active.withColumn("next", F.max("rank").over(order)).where(F.col("next").isNotNull())
            joint = ranked(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rank").alias("left"), "next", "n"), ["left", "next"])
            joint = small(materialised(joint.select("left", F.col("next").alias("right"), F.col("rank").alias("joint")), "joint"))
            met = pairs.join(joint, (F.col("rank") == F.col("left")) & (F.col("next") == F.col("right")))
            active = materialised(met.select("no", "doc", "t", "p", F.col("joint").alias("rank")), "suffixes")
        depth *= 2
    if not found:
        return windows.limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(batches):
    """``row, text, ranges, everything`` to ``row, text, n_lines, n_deleted``."""
    for batch in batches:
        texts, lines, deleted = [], [], []
        for text, ranges, everything in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            parts = (text or "").split("\n")
            spoken = [k for k, x in enumerate(parts) if x.strip(BLANKS)]
            gone = set(range(len(spoken))) if everything else {k for r in ranges or () for k in range(r["i"], r["i"] + r["m"])}
            if gone:
                drop = {spoken[k] for k in gone}
                text = "" if len(gone) == len(spoken) else "\n".join(x for k, x in enumerate(parts) if k not in drop)
            texts.append(text)
            lines.append(len(spoken))
            deleted.append(len(gone))
        columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(deleted, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_deleted"])


def cut(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """``row`` (a struct of the other columns of ``docs``), ``text``, ``n_lines``, ``n_deleted``."""
    docs = small_batches(docs)
    kept = docs.select(packed_row(docs, text_col), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    text = text_of("text")
    ta, tb = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    rows = kept.select(F.col("id").isNull().alias("no"), F.col("id").alias("doc"), ta.alias("t"), tb.alias("u"), spoken_lines(text).alias("lines")).where(F.size("lines") > 0)
    first = F.min(F.struct("no", "doc")).alias("first")
    texts = rows.groupBy("t", "u").agg(first, F.count(F.lit(1)).alias("copies"), F.any_value("lines").alias("lines"))
    texts = materialised(texts.select("first.no", "first.doc", "t", "u", "copies", "lines"), "texts")
    with step(docs.sparkSession) as lasting:
        gone = lasting(later_copies(texts, least).groupBy("no", "doc", "t").agg(F.collect_list(F.struct("i", "m")).alias("ranges")), "gone")
    gone = gone.withColumnsRenamed({"no": "g_no", "doc": "g_doc", "t": "g_t"})
    long = F.aggregate("lines", F.lit(0), lambda n, x: n + x["n"]) >= least
    marked = texts.join(gone, (F.col("no") == F.col("g_no")) & F.col("doc").eqNullSafe(F.col("g_doc")) & (F.col("t") == F.col("g_t")), "left")
    marked = marked.where(F.col("ranges").isNotNull() | (long & (F.col("copies") > 1)))
    marked = materialised(marked.select("t", "u", "doc", (long & (F.col("copies") > 1)).alias("copied"), "ranges"), "marked")

    met = kept.join(small(marked), (ta == F.col("t")) & (tb == F.col("u")), "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    # of the rows that hold the first id of a copied text, one stays
    own = F.col("copied") & F.col("id").eqNullSafe(F.col("doc"))
    nth = F.row_number().over(Window.partitionBy("t", "u", "id").orderBy("id"))
    firsts = met.where(own).withColumn("everything", nth > 1)
    others = met.where(~own).withColumn("everything", F.col("copied"))
    ready = others.unionByName(firsts).select("row", "text", "ranges", "everything")
    return ready.mapInArrow(_cut, f"row {kept.schema['row'].dataType.simpleString()}, text string, n_lines bigint, n_deleted bigint")


def deduplicated(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the text's later copies of line runs deleted; and ``n_lines`` (with a word), ``n_deleted``,
    which take the place of columns of these names.

    Lines are equal if they are so without spaces at their ends; lines without a word are passed over and stay, unless no other
    line is left: then the text is empty. The corpus order is that of ids, rows without an id last, then of a hash of the text. Of
    repeated rows one keeps its lines. A text of fewer than ``least`` words stays as it is, as do null and empty texts; an empty
    table gives no rows.
    """
    ours = ("n_lines", "n_deleted")
    return cut(docs, least, id_col, text_col).select(*unpacked(docs, {text_col: F.col("text")}, ours), *ours)


def filtered(docs: DataFrame, least: int = 50) -> DataFrame:
    """``documents`` after ``deduplicated``: documents that lost all their lines are gone, ``n_chars`` follows the text.

    Null and empty texts lose nothing and stay; of repeated rows one stays, if the text has ``least`` words; an empty table gives no rows.
    """
    out = cut(docs, least, "doc_id", "text").where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(unpacked(docs, changed))
