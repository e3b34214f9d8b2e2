"""Awkward rows that every operator must take."""

LONG = "lorem ipsum dolor sit amet " * 20_000
AWKWARD = [
    (1, "The cat sat on the mat and the dog ran off to the old mill.", "en", "a", 60),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n\t ", "en", "b", 5),
    (5, LONG, "la", "b", len(LONG)),
    (6, "The cat sat on the mat and the dog ran off to the old mill.", "en", "a", 60),
    (6, "The cat sat on the mat and the dog ran off to the old mill.", "en", "a", 60),
    (None, "a row without an id, 日本語 🙂 ﬁ", "en", "c", 20),
    (8, "x", None, "", 1),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DDL).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DDL)
