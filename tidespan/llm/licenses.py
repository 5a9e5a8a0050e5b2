"""Licence scans with a positional index of rare tokens.

One pass over the corpus counts in how many documents each licence word occurs.  The index posts, for each template,
the rarer half of its words with their positions; common words have no postings.  A file is looked up by its own
licence words of highest IDF: each of their places p, with a posting at q, puts a template at p - q.  Postings are
intersected by this relative position, with some slack for inserted or missing words: a template is a candidate
where two of the words agree.  It counts once its mandatory key phrases stand where the template has them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, LOWER, map_arrow, spread, text_slices, word_hashes, words
from .licence_texts import TEMPLATES

#: Base labels: (phrase, label).
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Candidate places of a template that are verified together.
TOGETHER = 1024


def normal_words(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM_WORDS)
    return [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Index:
    """Templates with postings of their rarer words.

    idf: of every word; rare: how many of a file's words are looked up; slack: by how many words a template's words may
    be out of place."""

    def __init__(self, idf: dict[str, float], rare: int = 12, slack: int = 8, templates=TEMPLATES):
        self.rare, self.slack = rare, slack
        texts = [normal_words(t) for _, t, _ in templates]
        phrases = [p.split() for p, _ in PHRASES]
        self.names = sorted({w for t in [*texts, *phrases] for w in t})
        code = {w: i for i, w in enumerate(self.names)}
        data = LOWER[np.frombuffer(" ".join(self.names).encode(), np.uint8)]
        hashes = word_hashes(data, *words(data, np.array([0, len(data)]), ALNUM_WORDS)[:2])
        order = np.argsort(hashes)
        self.vocabulary, self.code = hashes[order], order  # sorted hashes, and the word of each
        self.order = sorted(range(len(self.names)), key=lambda i: (-idf.get(self.names[i], 0.0), self.names[i]))  # rarest first
        self.place = {w: n for n, w in enumerate(self.order)}
        self.base = [([code[w] for w in p], label) for p, (_, label) in zip(phrases, PHRASES, strict=True)]
        self.labels = [label for label, _, _ in templates]
        self.texts = [np.array([code[w] for w in t]) for t in texts]
        self.keys = []
        for t, (_, _, keys) in zip(texts, templates, strict=True):
            cut = [k.split() for k in keys]
            self.keys.append([(np.array([code[w] for w in k]), next(i for i in range(len(t)) if t[i : i + len(k)] == k)) for k in cut])
        self.mandatory = [{int(w) for k, _ in keys for w in k} for keys in self.keys]
        self.postings: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.posted: list[list[int]] = []
        for n, t in enumerate(self.texts):
            own = sorted(set(t.tolist()), key=self.place.__getitem__)
            self.posted.append(own[: (len(own) + 1) // 2])
            for w in self.posted[-1]:
                self.postings.setdefault(w, []).append((n, np.flatnonzero(t == w)))
        self.is_posted = np.zeros(len(self.names), bool)
        self.is_posted[list(self.postings)] = True

    def lookups(self, present: set[int]) -> list[int]:
        """The words that a file is looked up by: its `rare` posted words of highest IDF; and for a template whose
        mandatory words it has but of which fewer than two words are among these, the two rarest that it has."""
        mine = sorted((w for w in present if self.is_posted[w]), key=self.place.__getitem__)
        chosen = set(mine[: self.rare])
        if len(mine) > self.rare:
            first = frozenset(chosen)
            for posted, needed in zip(self.posted, self.mandatory, strict=True):
                if needed <= present and len(first.intersection(posted)) < 2:
                    chosen.update([w for w in posted if w in present][:2])
        return sorted(chosen)

    def candidates(self, where: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each template the relative positions d from which on, within slack, two looked-up words agree (one, where
        the file has only one of the template's)."""
        votes: dict[int, list[tuple[np.ndarray, int]]] = {}
        for w in self.lookups(set(where)):
            for t, q in self.postings[w]:
                votes.setdefault(t, []).append(((where[w][:, None] - q).ravel(), w))
        out = {}
        for t, parts in votes.items():
            d = np.concatenate([x for x, _ in parts])
            if len(parts) == 1:
                out[t] = np.unique(d)
                continue
            w = np.repeat(np.arange(len(parts)), [len(x) for x, _ in parts])
            order = np.lexsort((w, d))
            d, w = d[order], w[order]
            other = np.full(len(d), len(d))  # the next vote of another word
            change = np.flatnonzero(w[1:] != w[:-1])
            other[:-1] = np.append(change + 1, len(d))[np.searchsorted(change, np.arange(len(d) - 1))]
            near = np.append(d, np.iinfo(np.int64).max)[other] - d <= self.slack
            if near.any():
                out[t] = np.unique(d[near])
        return out

    def scan(self, at: np.ndarray, word: np.ndarray) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """One document: the places of licence words, and which words these are."""
        order = np.lexsort((at, word))
        cut = np.flatnonzero(np.diff(word[order])) + 1
        where = {int(word[p[0]]): at[p] for p in np.split(order, cut)} if len(at) else {}
        nowhere = np.zeros(0, np.int64)

        def places(phrase) -> np.ndarray:
            hits = where.get(int(phrase[0]), nowhere)
            for i, w in enumerate(phrase[1:], 1):
                hits = hits[np.isin(hits + i, where.get(int(w), nowhere))]
            return hits

        n, found, base = 0, [], set()
        for phrase, label in self.base:
            hits = places(phrase)
            if len(hits):
                n += len(hits)
                found += [int(hits[0]), int(hits[-1])]
                base.add(label)
        labels, score = set(base), 0.5 if base else 0.0
        for t, d in self.candidates(where).items():
            for phrase, q in self.keys[t]:
                d = d[_within(places(phrase) - q, d, self.slack)]
            if len(d):
                labels.add(self.labels[t])
                score = max(score, self.agreement(where, t, d))
        return n, min(found, default=None), max(found, default=None), base, labels, score

    def agreement(self, where: dict[int, np.ndarray], t: int, d: np.ndarray) -> float:
        """The largest share of template t's words that stand within slack of their places, over positions d."""
        best, nowhere = 0.0, np.zeros(0, np.int64)
        for lo in range(0, len(d), TOGETHER):
            part = d[lo : lo + TOGETHER]
            hits = np.zeros(len(part), np.int64)
            for q, w in enumerate(self.texts[t].tolist()):
                hits += _within(where.get(w, nowhere) - q, part, self.slack)
            best = max(best, int(hits.max()) / len(self.texts[t]))
        return best


def _within(x: np.ndarray, d: np.ndarray, slack: int) -> np.ndarray:
    """For each d whether some of the sorted x lies within slack of it."""
    if not len(x):
        return np.zeros(len(d), bool)
    at = np.searchsorted(x, d - slack)
    return (at < len(x)) & (x[np.minimum(at, len(x) - 1)] <= d + slack)


def _prepared(batch: pa.RecordBatch, index: Index):
    """Slices of a batch: (number of rows, words per row, places of licence words in their rows, their rows, the words)."""
    for lo, hi, data, offs in text_slices(batch, "text"):
        data = LOWER[data]
        starts, ends, doc = words(data, offs, ALNUM_WORDS)
        h = word_hashes(data, starts, ends)
        place = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
        at = np.flatnonzero(index.vocabulary[place] == h)
        count = np.bincount(doc, minlength=hi - lo)
        first = np.cumsum(count) - count
        yield hi - lo, count, at - first[doc[at]], doc[at], index.code[place[at]]


def word_idf(texts: DataFrame) -> dict[str, float]:
    """IDF of every licence word over all documents: one pass, one row per word and task."""
    names = Index({}).names

    def run(batches):
        index = Index({})
        df, n = np.zeros(len(names), np.int64), 0
        for batch in batches:
            for rows, _, _, doc, word in _prepared(batch, index):
                df += np.bincount(np.unique(doc * len(names) + word) % len(names), minlength=len(names))
                n += rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.r_[n, df])], ["w", "n"])

    counts = {r["w"]: r["n"] for r in map_arrow(texts, run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(-1, 0)
    return {w: math.log((1 + total) / (1 + counts.get(i, 0))) for i, w in enumerate(names)}


def scan_licenses(docs: DataFrame, rare: int = 12, slack: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score: the largest share of a verified template's words that stand within slack of their places; 0.5 at least with
    a base phrase, 0 with no label.  A null text has no words; null ids stay null; repeated rows each give a row; an
    empty table gives an empty one; other columns are not read.  Whole texts, two passes, no shuffle of texts but of a
    table too small to occupy all cores.
    """
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    idf = word_idf(texts.select("text"))

    def run(batches):
        index = Index(idf, rare, slack)
        base_words = {w for p, _ in index.base for w in p}
        useful = index.is_posted.copy()
        useful[list(base_words)] = True
        for batch in batches:
            n_words: list[np.ndarray] = []
            out = []
            for rows, count, at, doc, word in _prepared(batch, index):
                n_words.append(count)
                found = [(0, None, None, "", "", 0.0)] * rows
                mine = np.isin(doc, np.unique(doc[useful[word]]))
                for d, places, ws in _grouped(doc[mine], at[mine], word[mine]):
                    n, lo, hi, base, labels, score = index.scan(places, ws)
                    found[d] = (n, lo, hi, ",".join(sorted(base)), ",".join(sorted(labels)), score)
                out += found
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                schema.names,
            )

    long, string = T.LongType(), T.StringType()
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, long) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [T.StructField(c, string) for c in ("base_labels", "labels")]
        + [T.StructField("score", T.DoubleType())]
    )
    return map_arrow(texts, run, schema)


def _grouped(doc: np.ndarray, *columns: np.ndarray):
    """(row, its part of each column) of each row that has any (rows ascending)."""
    if len(doc):
        cut = np.flatnonzero(np.diff(doc)) + 1
        yield from zip(doc[np.r_[0, cut]].tolist(), *[np.split(c, cut) for c in columns], strict=True)
