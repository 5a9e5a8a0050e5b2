"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched once for credential-like strings.  Every value found is hashed and counted by the distinct
repositories and owners that hold it: a value that many owners hold is an example copied from documentation, one
that stays with few owners and looks like a credential (long or mixed enough, no placeholder) looks live.  Tables
hold the SHA-256 of values, never the values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: A private key as a whole, so that the value tells one key from another: from the BEGIN line through the END line, or
#: where none follows, to the end of the base64 lines (a last one of under 16 characters needs its padding).  Line
#: breaks may be written as \\n.  Possessive loops don't recurse.
_PEM_BREAK = r"(?:[\x09-\x0D\x20]|\\[rn])"
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_PEM_BREAK}++[A-Za-z0-9+/]{{32,}}+={{0,2}}+)++(?:{_PEM_BREAK}++[A-Za-z0-9+/]{{16,31}}+={{0,2}}+|{_PEM_BREAK}++[A-Za-z0-9+/]{{1,15}}+={{1,2}}+)?+)?+"
)

#: (kind, a cheap test that a text may hold one, pattern, group with the value, least length of that group).
#: The first three are the base kinds; the rest are this method's own.  access and hex are written with their least
#: length in the pattern: a run that fails it is maximal, so nothing inside it could match on its own.
KINDS: list[tuple[str, str, str, int, int]] = [
    ("assign", r"(?i)password|passwd|secret|token|api_?key", _ASSIGN, 2, 8),
    ("access", "AKIA", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32),
    ("pem", "PRIVATE KEY-----", _PEM, 0, 20),
    ("forge", r"gh[oprsu]_[A-Za-z0-9]{30}", r"gh[oprsu]_[A-Za-z0-9]{30,}", 0, 34),
]
BASE = ("assign", "access", "hex")
#: Values with one of these are placeholders.
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|change_me|your_|dummy|redacted|xxxx"
_SPANS = "array<struct<start:int,ord:int,kind:string,end:int,at:int,value_hash:string,credible:boolean>>"
#: Tasks that the rows of one hot value are dealt to where they meet its verdict.
SALTS = 16


def credible(kind: str, value: Column) -> Column:
    """Whether a value looks like a real credential: a private key with a body; else no placeholder, with at least
    eight distinct characters, or for an assignment six, and two of lower case, upper case, digits and other marks
    unless it is 20 characters long."""
    if kind == "pem":
        return F.char_length(value) >= 100
    distinct = F.size(F.array_distinct(F.split(value, "")))
    if kind != "assign":
        return ~value.rlike(PLACEHOLDER) & (distinct >= 8)
    classes = reduce(lambda a, b: a + b, (value.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")))
    return ~value.rlike(PLACEHOLDER) & (distinct >= 6) & ((classes >= 2) | (F.char_length(value) >= 20))


def _matches(text: str, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: what lies between the matches and the matches themselves add up to their places."""
    rx = F.lit(pattern)
    between, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group))
    parts = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("all"), value.alias("value"))
    empty = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.char_length(x["all"])
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("ord"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            (end - F.char_length(x["value"])).alias("at"),  # every pattern ends with its value
            F.sha2(x["value"], 256).alias("value_hash"),
            F.coalesce(credible(kind, x["value"]), F.lit(False)).alias("credible"),
        )
        return F.struct(end.alias("pos"), F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_spans(df: DataFrame, text: Column, *keep: str | Column) -> DataFrame:
    """keep, and spans: array of (start, ord, kind, end, at, value_hash, credible) by start, then kind as in KINDS; the
    value lies from at to end."""
    df = df.select(*keep, F.coalesce(text, F.lit("")).alias("_t"))
    names = [c for c in df.columns if c != "_t"]
    none = F.array().cast(_SPANS)
    found = [F.when(F.col("_t").rlike(test), _matches("_t", i, kind, rx, group, least)).otherwise(none).alias(f"_s{i}") for i, (kind, test, rx, group, least) in enumerate(KINDS)]
    spans = F.array_sort(reduce(F.concat, [F.col(f"_s{i}") for i in range(len(KINDS))]))
    return df.select(*names, *found).select(*names, spans.alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """rid, doc_id, repo, spans (see _with_spans) for every row, stored: one scan of the texts.  rid numbers the rows."""
    found = _with_spans(docs, F.col(text_col), F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"))
    return stored(found.select(F.monotonically_increasing_id().alias("rid"), "*"), "spans")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners over the whole corpus.  An owner is the part of the repository before a slash;
    a null repository counts as one unnamed one.  Rows are reduced to distinct (hash, repository) before the
    shuffle, so a value copied everywhere weighs no more than the number of repositories."""
    held = found.select(F.coalesce("repo", F.lit("")).alias("repo"), F.explode("spans.value_hash").alias("value_hash")).distinct()
    held = held.withColumn("owner", F.substring_index("repo", "/", 1))
    by_owner = held.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(found: DataFrame, shared_owners: int = 3) -> DataFrame:
    """Verdict of every span: rid, doc_id, repo, kind, start, end, at, value_hash, credible, n_repos, n_owners, shared
    (shared_owners owners or more hold the value), live (credible and not shared)."""
    each = found.select("rid", "doc_id", "repo", F.inline("spans")).drop("ord")
    each = each.join(ownership(found), "value_hash").withColumn("shared", F.col("n_owners") >= shared_owners)
    return each.withColumn("live", F.col("credible") & ~F.col("shared"))


def _judged(found: DataFrame, shared_owners: int) -> DataFrame:
    """rid, at, end, credible, shared of every span.  Only the few shared values are joined; the rows of each are
    dealt to SALTS tasks."""
    shared = ownership(found).where(F.col("n_owners") >= shared_owners)
    shared = shared.select("value_hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("shared"))
    each = found.select("rid", F.inline("spans")).select("rid", "at", "end", "credible", "value_hash", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("_salt"))
    return each.join(shared, ["value_hash", "_salt"], "left").select("rid", "at", "end", "credible", F.coalesce("shared", F.lit(False)).alias("shared"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def summarize(found: DataFrame, shared_owners: int = 3) -> DataFrame:
    """One row per row of found: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared.

    found: what find() gives.  n_shared counts spans whose value shared_owners owners or more hold, n_live the credible
    ones among the others.  A null text counts as empty; a null id or repository stays null; repeated rows each give a
    row of their own; an empty table gives an empty one; other columns are not read.
    """
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    rows = found.select(
        "rid",
        "doc_id",
        *[F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
    each = _judged(found, shared_owners).groupBy("rid")
    counts = each.agg(F.sum((F.col("credible") & ~F.col("shared")).cast("long")).alias("n_live"), F.sum(F.col("shared").cast("long")).alias("n_shared"))
    none = rows.where(F.col("spans") == "").withColumn("n_live", F.lit(0).cast("long")).withColumn("n_shared", F.lit(0).cast("long"))
    some = rows.where(F.col("spans") != "").join(counts, "rid", "left")
    return none.unionByName(some).drop("rid")


def _cut(text: Column, cuts: Column, mark: str) -> Column:
    """text with mark in place of each of the cuts (at, end), sorted; overlapping ones count as one."""

    def step(acc: Column, x: Column) -> Column:
        apart = x["at"] >= acc["pos"]
        piece = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.greatest(x["at"] - acc["pos"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(apart, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.char_length(text))))


def redact(docs: DataFrame, shared_owners: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """docs with the values of live-looking secrets replaced by mark where they were found (and n_chars recounted).

    Needs columns text, source.  Texts are searched once and written with their spans; those without a span pass from
    there, only the others are joined with the verdicts.  Null texts pass unchanged; null ids, repeated rows and
    columns of any other name don't matter; an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = _with_spans(docs, F.col("text"), whole.alias("row"), F.col("source").cast("string").alias("repo"))
    marked = stored(marked.select(F.monotonically_increasing_id().alias("rid"), "*"), "marked")
    hit = marked.where(F.size("spans") > 0)
    live = _judged(hit.select("rid", "repo", "spans"), shared_owners).where("credible and not shared")
    cuts = live.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("at", "end"))).alias("cuts"))
    masked = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(_cut(F.col("row.text"), F.col("cuts"), mark))
    hit = hit.join(cuts, "rid", "left").select(F.col("row").alias("_row"), masked.alias("_text"), F.col("cuts").isNotNull().alias("_masked"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        n = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("_masked"), n).otherwise(F.col("_row.n_chars"))
    changed = hit.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
    return marked.where(F.size("spans") == 0).select("row.*").unionByName(changed)
