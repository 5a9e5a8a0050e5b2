"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target documents (labelled good) and one of all raw text, give
each document the log ratio of its text under both.  Gumbel noise added to it makes the top k a sample without
replacement whose odds follow the ratio.  Words and pairs of words have half of the buckets each, so that the many
pairs don't blur the words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_table, map_arrow, spread, stored, text_slices, window_hashes, word_hashes, words

_LETTERS = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_MARKS = ~(_LETTERS | byte_table((0, 32)))


def _hashed_grams(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every unigram and bigram; tokens are runs of letters and digits and runs of other marks."""
    a, b = words(data, offs, _LETTERS), words(data, offs, _MARKS)
    order = np.argsort(np.r_[a[0], b[0]], kind="stable")
    starts, ends, doc = (np.r_[x, y][order] for x, y in zip(a, b, strict=True))
    h = word_hashes(data, starts, ends)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    half = np.uint64(buckets // 2)
    return np.r_[doc, doc[pair]], np.r_[h % half, window_hashes(h, 2)[pair] % half + half].astype(np.int64)


def target_ids(labels: DataFrame, most: int, seed: int) -> tuple[np.ndarray, float]:
    """Ids of about `most` documents labelled good and not toxic (those of least hashed id), and their share
    of the labelled documents.  A document with several labels counts by its worst."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    n, n_good = worst.agg(F.count("*"), F.sum(good.cast("long"))).first()
    share = min(1.0, most / n_good) if n_good else 1.0
    chosen = worst.where(good & (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return chosen.select(F.col("doc_id").cast("long").alias("i")).toArrow().column("i").to_numpy(), (n_good or 0) / n if n else 1.0


def log_ratios(texts: DataFrame, target: np.ndarray, buckets: int, prior: float) -> np.ndarray:
    """log p_target / p_raw by bucket.  Counts cover all of texts (doc_id, text); each task adds up its own and sends
    one row per bucket.  prior raw-like occurrences are added to either side, so rare buckets say little."""
    ids = np.sort(target)

    def run(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flag = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), ids) if len(ids) else np.zeros(batch.num_rows, bool)
            for lo, hi, data, offs in text_slices(batch, "text"):
                row, bucket = _hashed_grams(data, offs, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[flag[lo:hi][row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["b", "raw", "good"])

    counts = map_arrow(texts, run, "b long, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[counts.column("b").to_numpy()] = counts.column("raw").to_numpy()
    good[counts.column("b").to_numpy()] = counts.column("good").to_numpy()
    expected = raw * (good.sum() / max(raw.sum(), 1.0))
    return np.log((good + prior) / (expected + prior))


def weigh(
    docs: DataFrame, target: np.ndarray, buckets: int = 1 << 20, prior: float = 1.0, scale: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_grams, log_weight: the log of the text's likelihood under the target model over that under the raw one.
    With scale, the mean log ratio of its n-grams times scale instead: documents weigh as if scale n-grams long, so that
    length doesn't decide.  0 for a text without n-grams."""
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    ratio = texts.sparkSession.sparkContext.broadcast(log_ratios(texts.withColumn("doc_id", F.col("doc_id").cast("long")), target, buckets, prior))

    def run(batches):
        for batch in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for lo, hi, data, offs in text_slices(batch, "text"):
                row, bucket = _hashed_grams(data, offs, buckets)
                n.append(np.bincount(row, minlength=hi - lo))
                total.append(np.bincount(row, ratio.value[bucket], minlength=hi - lo))
            count = np.concatenate(n)
            weight = np.concatenate(total)
            if scale is not None:
                weight = scale * weight / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(weight)], ["doc_id", "n_grams", "log_weight"])

    kind = docs.schema[id_col].dataType
    return map_arrow(texts, run, T.StructType([T.StructField("doc_id", kind), T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())]))


def kth_largest(df: DataFrame, column: str, k: int, together: int = 10_000) -> tuple[float, int]:
    """The k-th largest value of a double or long column (1 <= k <= rows), and how many rows are greater.  Histograms narrow
    the range until `together` rows or a single value are left; nothing is sorted or gathered as a whole."""
    above = 0
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    while n > together and low < high:
        cell = F.least(F.floor((F.col(column) - low) / ((high - low) / 1024)), F.lit(1023))
        cells = df.where(F.col(column).between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for c in sorted(cells.collect(), key=lambda r: -r["c"]):  # at most 1024 rows
            if above + c["n"] >= k:
                low, high, n = c["lo"], c["hi"], c["n"]
                break
            above += c["n"]
    if low == high:
        return low, above
    values = sorted((r[0] for r in df.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
    value = values[k - above - 1]
    return value, above + sum(v > value for v in values)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    most_targets: int = 20_000,
    buckets: int = 1 << 20,
    scale: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept for every row; kept marks the top k = round(share * rows) keys.

    share: by default the share of labelled documents that are of quality 1 and not toxic.  The target model is fitted
    on about most_targets labelled documents at most; the raw model on all documents.  scale: see weigh().

    Exactly k rows are kept: among equal keys the smaller id goes first (null last), among rows equal in both the one
    that the scan gives first.  A null text has no n-grams and weight 0; a null id is kept as null and takes the noise
    of the null value; without labels all weights are 0 and everything is kept; an empty table gives an empty one;
    other columns are not read.
    """
    target, good = target_ids(labels, most_targets, seed)
    share = good if share is None else share
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    keyed = weigh(docs, target, buckets, scale=scale, id_col=id_col, text_col=text_col).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    before = -F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    keyed = stored(keyed.withColumn("_before", before).withColumn("_nth", -F.monotonically_increasing_id()), "importance")
    k = math.floor(share * keyed.count() + 0.5)
    kept = F.lit(False)
    if k:
        key, above = kth_largest(keyed, "gumbel_key", k)
        tied = keyed.where(F.col("gumbel_key") == key)
        first, earlier = kth_largest(tied, "_before", k - above)
        nth, _ = kth_largest(tied.where(F.col("_before") == first), "_nth", k - above - earlier)
        own = (F.col("_before") > first) | ((F.col("_before") == first) & (F.col("_nth") >= nth))
        kept = (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & own)
    return keyed.withColumn("kept", kept).drop("_before", "_nth")
