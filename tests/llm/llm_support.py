"""Small tables with the awkward cases: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

from pyspark.sql import functions as F

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{i % 997} é漢🙂" for i in range(20_000))
PROSE = "\n".join(" ".join(f"w{line}x{i}" for i in range(30)) for line in range(6))


def documents(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT)


def awkward(spark):
    rows = [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, " \t\n\x0b \r", "en", "s", 6),
        (4, "one two", "en", "s", 7),
        (5, LONG, "en", "s", len(LONG)),
        (6, PROSE, "en", "s", len(PROSE)),
        (6, PROSE, "en", "s", len(PROSE)),
        (7, PROSE, "de", "t", len(PROSE)),
        (7, PROSE + " and more", "de", "t", len(PROSE) + 9),
        (None, "a row without an id has words too", "en", "s", 33),
        (None, None, None, None, None),
        (9, "x" * 300_000, "en", "s", 300_000),
        (10, "\n\n" + PROSE.split("\n")[2] + "\n\n" + PROSE.split("\n")[3], "en", None, 1),
    ]
    return spark.createDataFrame(rows, DOCUMENT)


#: Names that the operators use inside.
NAMES = ("row", "id", "key", "n", "t", "u", "doc", "host", "ta", "tb", "_id", "_ta", "_tb", "_host", "gone", "ranges", "copied", "everything", "words", "lines", "score", "n_lines", "n_deleted", "length", "piece")


def with_clashes(frame):
    return frame.withColumns({c: F.lit(7) for c in NAMES if c not in frame.columns})


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))
