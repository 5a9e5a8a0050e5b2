"""Language identification with word-first backoff.

A word that the model knows is scored by its log frequency in each language.  An unseen word is scored by its
character n-grams: the longest length of which any gram is known decides, progressively shorter ones are the
fallback.  The model is a bounded table, fitted on a bounded sample; prediction is one pass without a shuffle.

A word is a letter and the letters and combining marks that follow it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spread, text_slices

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 4
#: Scores of this many distinct space-separated chunks are kept by a Python worker before it starts afresh.
CACHE_CHUNKS = 30_000


def grams(word: str, n: int) -> list[str]:
    """The word's character n-grams, its ends marked; the marks alone are no 1-grams."""
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language: one row of a matrix for each word (level 0) and character n-gram (level n)."""

    def __init__(self, rows: list[tuple[str, int, str, int]], languages: list[str]):
        self.languages = languages
        column = {lang: i for i, lang in enumerate(languages)}
        self.levels: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        at = [self.levels[level].setdefault(gram, len(self.levels[level])) for _, level, gram, _ in rows]
        first = np.cumsum([0] + [len(d) for d in self.levels])
        for level, d in enumerate(self.levels):
            self.levels[level] = {g: i + int(first[level]) for g, i in d.items()}
        counts = np.zeros((int(first[-1]), len(languages)))
        for (lang, level, _, n), i in zip(rows, at, strict=True):
            counts[first[level] + i, column[lang]] += n
        self.known = counts[: len(self.levels[0])] > 0  # which languages have the word
        self.scores = np.zeros_like(counts)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            part = counts[lo:hi] + 0.5
            self.scores[lo:hi] = np.log(part / (part.sum(axis=0) + 0.5))

    def rows(self, word: str) -> list[int]:
        """The word's own row, or those of its n-grams of the longest length that has any."""
        own = self.levels[0].get(word)
        if own is not None:
            return [own]
        for n in range(LONGEST, 0, -1):
            level = self.levels[n]
            found = [r for g in grams(word, n) if (r := level.get(g)) is not None]
            if found:
                return found
        return []

    def word(self, word: str) -> np.ndarray:
        return self.scores[self.rows(word)].sum(axis=0)


class Scorer:
    """Scores of whole texts, by way of a cache of space-separated chunks.

    A chunk's row holds its letters, the letters of its words that each language knows, and each language's score."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 1 + 2 * len(self.model.languages)))

    def learn(self, new: list[str]) -> None:
        rows: list[int] = []
        owner: list[int] = []
        size: list[int] = []
        at: list[int] = []
        whole: list[int] = []  # the row of a word that is known as such, else that of no word
        find, words = self.model.rows, len(self.model.known)
        for i, chunk in enumerate(new):
            for word in _WORD.findall(chunk.lower()):
                got = find(word)
                rows += got
                owner += [i] * len(got)
                at.append(i)
                size.append(len(word))
                whole.append(got[0] if got and got[0] < words else words)
        values, by = self.model.scores[rows], np.array(owner, np.int64)
        has = np.vstack([self.model.known, np.zeros((1, self.model.known.shape[1]), bool)])[whole] * np.array(size)[:, None]
        columns = [np.bincount(at, size, len(new)), *[np.bincount(at, c, len(new)) for c in has.T], *[np.bincount(by, c, len(new)) for c in values.T]]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.table = np.concatenate([self.table, np.stack(columns, axis=1)])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, known letters by language, score by language) of each text (large strings, no nulls)."""
        n = len(self.model.languages)
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        if new := [c for c in own if c not in self.known]:
            self.learn(new)
        code = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        total = np.add.reduceat(self.table[code], split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), axis=0)
        return total[:, 0], total[:, 1 : 1 + n], total[:, 1 + n :]


def _judged(scorer: Scorer, batch: pa.RecordBatch):
    """(best language, posterior, share of letters in words that this language knows, letters) of every row; -1 is the
    best language of a text without letters, and of any text where the model has none."""
    texts = batch.column(batch.schema.get_field_index("text"))
    parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))]
    for lo, hi, _, _ in text_slices(batch, "text"):
        letters, known, score = scorer.texts(texts.slice(lo, hi - lo).cast(pa.large_string()).fill_null(""))
        if not score.shape[1]:
            parts.append((np.full(hi - lo, -1), np.zeros(hi - lo), np.zeros(hi - lo), letters))
            continue
        best = score.argmax(axis=1)
        sure = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        share = known[np.arange(len(best)), best] / np.maximum(letters, 1)
        parts.append((np.where(letters > 0, best, -1), np.where(letters > 0, sure, 0.0), share, letters))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def fit(docs: DataFrame, learn: Column, per_language: int = 3000, words: int = 15_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows where learn holds and the language isn't null.

    The sample is bounded: about per_language documents of each language, those whose hashed id is least.  So is
    the model: for each language the `words` most frequent words, and half as many n-grams of each length.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count("*")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])[F.col(lang_col)]
    chosen = F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 30)) < share * (1 << 30)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(*batch.columns, strict=True):
                lang = lang.as_py()
                seen.update((lang, word) for word in _WORD.findall(text.as_py().lower()))
                if len(seen) > 100_000:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    schema = "lang string, level int, gram string, n long"
    counts = map_arrow(spread(rows.where(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))), count, schema)
    counts = counts.groupBy("lang", "level", "gram").agg(F.sum("n").alias("n"))
    most = F.when(F.col("level") == 0, words).otherwise(words // 2)
    top = Window.partitionBy("lang", "level").orderBy(F.desc("n"), "gram")  # over the bounded sample
    best = counts.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most).drop("_r").toArrow()
    return Model(list(zip(*(best.column(c).to_pylist() for c in ("lang", "level", "gram", "n")), strict=True)), languages)


def _counted(seen: Counter) -> pa.RecordBatch:
    """Counts of (language, word) as rows for the words and their n-grams."""
    total: Counter = Counter()
    for (lang, word), n in seen.items():
        total[lang, 0, word] = n
        for level in range(1, LONGEST + 1):
            for g in grams(word, level):
                total[lang, level, g] += n
    lang, level, gram = zip(*total, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(level, pa.int32()), pa.array(gram, pa.string()), pa.array(list(total.values()), pa.int64())],
        ["lang", "level", "gram", "n"],
    )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from the whole text alone.

    score is the posterior of the predicted language under equal priors.  A null text, one without a letter, and
    any text where the model knows no language gives und with score 0.  Null ids stay null, repeated rows each give
    a row, an empty table gives an empty one, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 3 * words entries a language

    def run(batches):
        scorer = Scorer(shared.value)
        names = np.array([*scorer.model.languages, "und"], object)
        for batch in batches:
            best, sure, _, _ = _judged(scorer, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The documents kept for judging a model: crc32 of the id as text, modulo 4, is 2.  A null id isn't one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def reject_unknown(docs: DataFrame, least: float = 0.12, enough: int = 60) -> DataFrame:
    """docs without those whose language can't be told: no letters, or less than the share `least` of the letters in
    words that the predicted language knows.

    The posterior can't tell: over a whole text it is near 1 for any text, in an unlearned language too.  The share of
    known words doesn't grow with the text; function words alone are more than `least` of any prose.  A text of fewer
    than `enough` letters may have no function word: it goes only if its n-grams point to no language (posterior under
    one half).  Needs columns doc_id, text, lang.  Works on rows as they stand, so the decision is made in one pass: the
    text is scored next to the row's other columns, and no join is needed.  Null and empty texts go, repeated rows are
    judged alike, null ids and other columns don't matter, an empty table gives an empty one.
    """
    model = fit(docs, ~held_out())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            best, sure, share, letters = _judged(scorer, batch)
            yield batch.filter(pa.array((best >= 0) & np.where(letters < enough, sure >= 0.5, share >= least)))

    return map_arrow(spread(docs), run, docs.schema)
