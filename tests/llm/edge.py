"""Rows that every operator over documents must take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and another " * 20_000


def documents(spark, texts):
    """Documents of (doc_id, text) or (doc_id, text, lang), in several partitions."""
    rows = [(i, t, *(rest or ("en",)), "s", None if t is None else len(t)) for i, t, *rest in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def edge_documents(spark, *more):
    """Null, empty and blank texts, a null id, a repeated row, a very long text, odd characters."""
    return documents(spark, [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Plain words in a row, and more of them."),
        (5, "Plain words in a row, and more of them."), (None, "text without an id"), (6, LONG),
        (7, "\x00 odd   \U0001F600 characters é́ ﻿"), (8, "0123 4567"), *more,
    ])


def with_clashes(docs):
    """Additional columns named like what operators make on the way."""
    names = ("score", "fp", "row", "copy", "doc", "component_id", "label", "held_out", "sequence_id", "n", "x")
    return docs.withColumns({c: F.lit("clash") for c in names})
