"""Rows shared by the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __shard string, score string, label int"


def docs_frame(spark, rows):
    """Documents (id, text[, lang]) with extra columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), "x", "y", 1)
            for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "é"), (None, "no id at all"), (5, "same row"), (5, "same row"),
       (6, "word " * 30_000), (7, "x" * 300_000), (8, " non breaking 日本 text")]
