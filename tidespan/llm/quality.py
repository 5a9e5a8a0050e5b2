"""Rule bitmask ledger: every quality rule is evaluated once; its verdict is one bit of a long.

The ledger holds each document's measurements and failure bits.  A policy is a versioned mask over those bits, so
changing a policy, or asking what a single rule costs, reads the ledger and never the texts again.  Only built-in
DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a regular expression and as characters.
_GAP, _GAPS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: (name, failing condition); a rule's bit is its place here.  Places never change; new rules go to the end.
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "n_upper >= 20 and 100 * n_upper > 50 * word_chars"),
    ("exclamations", "n_words > 0 and 10 * n_exclamations > 3 * n_words"),
]

#: Versioned policies: the names of the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length", "duplicate_lines", "capitals", "exclamations"),
    "v2": ("few_words", "repeated_windows", "symbols", "word_length", "duplicate_lines"),  # tolerates emphasis
}


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _hashes() -> Column:
    """xxhash64 of each five consecutive words."""
    five = [F.col("_w")] * 5
    return F.when(
        F.col("n_words") >= 5,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")), lambda i: F.xxhash64(*[F.get(w, i + k) for k, w in enumerate(five)])),
    ).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text measurements n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words, n_upper, n_exclamations (all long).  A null text has no words, lines or characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    df = df.select(
        "doc_id",
        F.array_remove(F.split("_t", _GAP), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, _GAPS, "") != "").alias("_l"),
        F.char_length(F.translate("_t", _GAPS, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "!", ""))).cast("long").alias("n_exclamations"),
        F.char_length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    df = df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    ).drop("_l")
    df = df.withColumn("_g", _hashes()).drop("_w")
    # only texts with a repeated window go through the sort; the rest have no covered word
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_g")
    same = lambda i, j: F.get("_s", i)["h"] == F.get("_s", j)["h"]
    df = df.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(F.col("_s"), lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
                lambda x: x["i"],
            )
        ),
    ).drop("_s")
    reach = F.transform("_p", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_p", i + 1) - p, F.lit(5))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() with fail_bits, a long: bit i is set where rule i fails.

    Nulls: a null text fails few_words alone; a null id stays null.  Repeated rows each keep a row, an empty table
    gives an empty ledger, other columns are not read.  Texts of any length are measured whole.
    """
    bits = reduce(lambda a, b: a + b, (F.when(F.expr(cond), F.lit(1 << i)).otherwise(0) for i, (_, cond) in enumerate(RULES)))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and the policy's verdict kept (false where the base rules fail)."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return book.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0))


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of the policy does, by bitwise aggregation over the ledger: rule, n_failed, n_alone (documents
    that only this rule rejects, so dropping it would keep them), n_docs.  One pass, one row per distinct mask first."""
    held = F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")
    masks = book.groupBy(held).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = masks.select("bits", "n", F.inline(F.array(*rules)))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_alone"),
        F.sum("n").alias("n_docs"),
    )
