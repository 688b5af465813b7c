"""Awkward rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket int, key string, block int, ids string, row long, gone int, score int, line string, n_words string"
EXTRA = (5, 6, "k", 7, "i", 8, 9, 10, "l", "w")
LONG = "alpha beta gamma delta " * 40_000


def awkward(spark, more=()):
    rows = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (None, "a text without an id that is long enough"),
            (4, LONG), (5, "  \n\n  "), (6, "x"), (7, None), *more]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
