import random

import pytest


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, and columns whose names clash with the
    operators' own."""
    rnd = random.Random(5)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(30_000))
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, text, "en", "a/x"),
        (2, text, "en", "b/y"),
        (2, text, "en", "b/y"),
        (3, None, "en", "a/x"),
        (4, "", None, None),
        (5, " \t\n ", "fr", "c"),
        (None, text, None, "c"),
        (None, None, None, None),
        (6, long, "fr", "c"),
        (7, "one two", "en", "c"),
        (8, "ONE two", "fr", "c"),
        (9, text.replace("word30", "other") + " tail", "en", "d"),
        (10, "été 😀 — x y ퟿", "fr", "d"),
    ]
    cols = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, cols)
    clash = """_t _w h row seg key n spans repo rid item_id _values component label length _key _h _n _row _s _salt _rank k1 k2 bits
    node block comp tree a p q cuts _text _masked _before _nth kept quality toxic gumbel_key value_hash shared live _base _groups"""
    for c in clash.split():
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
