"""Small document tables with the odd cases every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_tokens", "count", "key", "value", "h", "pos", "score", "component_id"):
            df = df.withColumn(name, F.lit(1))
    return df


def shuffle_bytes(spark):
    """Shuffled rows on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        file = files.next()
        total += file.length() if file.getName().startswith("shuffle_") else 0
    return total


ODD = [
    (1, None),
    (2, ""),
    (3, "  \t\n "),
    (4, "one"),
    (5, "One two  three\u00a0four éa\u0301 ß ﬁ 漢字 \U0001f600 <s> </s> <|endoftext|>"),
    (6, " leading and trailing "),
    (7, "x" * 3000),
    (8, "word " * 4000),
    (None, "no id here"),
    (9, "mark ▁ inside ▁▁ runs▁ and  double  spaces\r\nlines\x0bhere\x1cthere"),
    (4, "one"),
]
