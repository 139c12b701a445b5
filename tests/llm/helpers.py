"""Shared by the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """documents rows of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here at all"), (None, None), (5, "dup " * 30), (5, "dup " * 30), (6, "café   naïve 　 x \x1c y"), (7, "long " * 40_000)]
