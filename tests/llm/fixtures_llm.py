"""Small document tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHES = ["fp", "fingerprint", "component_id", "score", "predicted", "digest", "row", "key", "size", "taken", "tail", "bucket", "n", "u", "v", "spans", "node", "hot", "anchor"]
WORDS = [f"{a}{b}" for a in "ka lo mi nu re sa te vo".split() for b in "ra len dis mo ta fin gor".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(spark, texts, ids=None, sources=None, clash=False):
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    if clash:
        for c in CLASHES:
            df = df.withColumn(c, df.text)
    return df


def awkward():
    """Texts: plain, NULL, empty, blank, one word, ties, repeated rows, non-ASCII, very long."""
    long = prose(60_000, 99)
    return [prose(80, 1), None, "", " \t\n\r\x0b\x0c ", "word", prose(80, 1), prose(80, 1).upper(), "naïve café   \U0001f600 \x85 ſ K", prose(3, 4), long, long + " end", "a" * 30_000, prose(200, 5), None, ""]
