"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items are partitioned by the size of their shingle set (powers of two).  A partition with at most u shingles keeps
the p = u - ceil(t * u) + 1 least hash values of each item: a document that contains a share t of an item's shingles
misses at most q - ceil(t * q) < p of them, so it contains at least one of the kept values, however long it is.
Every pair found that way is verified by exact shingle containment.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored, without

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _BREAK), "")


def with_shingles(df: DataFrame, text: Column, k: int) -> DataFrame:
    """Add _h: the distinct hashes of each k consecutive words; all words as one shingle where there are fewer.

    Readers must not filter on _h (explode_outer, not explode): the optimizer would push the filter below and write
    the splitting of the text out for every shingle."""
    df = df.withColumn("_w", normal_words(text)).withColumn("_n", F.size("_w"))
    w = [F.col("_w")] * k
    whole = F.array(F.xxhash64("_w"))
    each = F.transform(F.sequence(F.lit(0), F.col("_n") - k), lambda i: F.xxhash64(*[F.get(c, i + j) for j, c in enumerate(w)]))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_h", F.when(F.col("_n") >= k, each).when(F.col("_n") > 0, whole).otherwise(none))
    return df.withColumn("_h", F.array_distinct("_h")).drop("_w", "_n")


def items(benchmark: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """item_id, q (shingles), h (all), kept (the least p of them, p by the item's size partition)."""
    df = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = with_shingles(df, F.col("_t"), k).select("item_id", F.size("_h").alias("q"), F.sort_array("_h").alias("h"))
    upper = F.pow(F.lit(2), F.floor(F.log2("q")) + 1) - 1
    p = (upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1).cast("int")
    return df.withColumn("kept", F.slice("h", F.lit(1), F.least(p, F.col("q"))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every pair whose document holds at least the share
    threshold of the item's distinct k-word shingles.

    Texts are searched whole.  Null and empty texts hold and match nothing; a null document or item id is reported
    as null; rows equal in id and text count once; an empty table on either side gives no pairs; other columns are
    not read.  An item of fewer than k words is one shingle, its whole word sequence, and is found only in a document of
    the same words and no others: one to four words inside a longer text are no sign of a leak.
    """
    known = stored(items(benchmark, k, threshold, item_col, text_col), "items").where("q > 0")
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    hashed = with_shingles(text.withColumn("_key", F.xxhash64("_t")), F.col("_t"), k)
    signature = _small(known.select(F.explode("kept").alias("h"), "item_id").distinct())
    pairs = hashed.select("doc_id", "_key", F.explode_outer("_h").alias("h")).join(signature, "h").select("doc_id", "_key", "item_id").distinct()
    pairs = stored(pairs, "pairs")
    # verification: all shingles of the documents found, against all shingles of the items
    found = pairs.select("doc_id", "_key").distinct()
    again = text.withColumn("_key", F.xxhash64("_t")).join(found.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["doc_id", "_key"])
    again = with_shingles(again, F.col("_t"), k).select("doc_id", "_key", F.explode_outer("_h").alias("h"))
    every = _small(known.select(F.explode("h").alias("h"), "item_id", "q").distinct())
    exact = again.join(every, "h").groupBy("doc_id", "_key", "item_id", "q").agg(F.count("*").alias("n_shared"))
    exact = exact.where(F.col("n_shared") >= F.lit(threshold) * F.col("q") - 1e-9)
    exact = exact.alias("e").join(
        pairs.alias("p"),
        (F.col("e._key") == F.col("p._key")) & F.col("e.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("e.item_id").eqNullSafe(F.col("p.item_id")),
        "left_semi",
    )
    return exact.select("doc_id", "item_id", "n_shared", F.col("q").cast("long").alias("n_item"), (F.col("n_shared") / F.col("q")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """docs without the documents that hold a benchmark item.  Rows with a null id or text stay, rows of equal id go
    together, other columns don't matter; empty tables on either side leave docs as they are."""
    found = find_contaminated(docs.select("doc_id", "text"), benchmark, threshold, k).where("doc_id is not null")
    return without(docs, stored(found.select("doc_id").distinct(), "contaminated"))
