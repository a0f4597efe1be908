"""Small tables with the awkward rows every corpus operator must take: nulls, empty texts, ties, repeats, a very long text."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
WIDE = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in ("lang", "source", "digest", "label", "row", "key"))])

AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "Two words"),
    (6, "Two words"),
    (7, "x" * 70_000),
    (8, ("lorem ipsum dolor sit amet, " * 40 + "\n") * 60),
    (9, "tab\tand\x0bfeed\x0cand nbsp   sep"),
    (9, "tab\tand\x0bfeed\x0cand nbsp   sep"),
    (None, "a text without an id, to be taken like any other"),
    (None, None),
    (-5, "İstanbul ΣΑΣ straße <|endoftext|> \U0001f600 é"),
]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, DOCS)


def wide(spark, rows=AWKWARD):
    return spark.createDataFrame([(*r, "en", "src", "d", "l", "r", "k") for r in rows], WIDE)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def sample(spark, n=300, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet").limit(n)
