"""Hostile documents that all operators have to bear, and helpers for brute-force comparisons."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("text_", T.StringType())])

HOSTILE = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one"),
    (4, "one two three"),
    (4, "one two three"),
    (5, "ΣΑΣ İstanbul é <|endoftext|> K ſ token=ſecret"),
    (6, "word " * 9000),
    (7, "x" * 20_000),
    (8, "it's don't 'tis we'll 9's !! \x00\x1f\x85"),
    (9, None),
    (None, "no id here at all"),
    (10, "1" * 6000 + " +1 (234) 555-7788 " + "9" * 40),
    (11, "one two three"),
    (12, "🙂 " * 50 + "日本語テキスト"),
]


def hostile(spark, rows=HOSTILE):
    """Documents with clashing extra columns; a null doc_id, repeated rows, empty and very long texts among them."""
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
