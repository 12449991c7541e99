import pytest

#: Nulls, empty and long texts, repeated rows, ties, unusual white space.
EDGE = [
    (-1, None),
    (-2, ""),
    (-3, " \n\t "),
    (-4, "a"),
    (-5, "a b c d e f g h i j k l m n o p"),
    (-5, "a b c d e f g h i j k l m n o p"),
    (None, "a b c d e f g h i j k l m n o p"),
    (-6, "x" * 3000),
    (-7, "\u00e9t\u00e9 \u3000 \u65e5\u672c\u8a9e \U0001f389 " * 40),
    (-8, "Mail a.b@c-d.example.org or +1 (499) 555-6503, then (499) 555-6503. token = \"1eb9c654e721b4f812088970e66a6345\""),
]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The smallest table with edge cases, an extra column and one with a clashing name."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edge = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    return real.unionByName(edge).withColumn("score", F.lit("clash")).withColumn("bucket", F.lit(1))


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
