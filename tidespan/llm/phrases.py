"""Substring deduplication with repeated-phrase automata.

A window is `size` consecutive words.  Its anchor is the least hash among its `gram`-word sequences, so equal
windows have equal anchors, and about seven windows in a row share one.

1. Anchors are counted over the corpus, by the places of their words.  Those of more than one place go into a bit
   map of bounded size; it only drops places that cannot recur, and where it is too full to drop much the rest of
   the work is still right.
2. All documents are streamed past the bit map.  A segment is a run of windows with one anchor; each place is
   written as (segment hash, document, position), the words of each distinct segment about once per task.
3. Segments meet by anchor, which is the shard key; an anchor with very many places is sharded by the window itself.
   Whole keys are gathered up to a fixed number of segments.  A shard confirms the windows that have two places,
   compiles them into an Aho-Corasick automaton over groups of words, and streams its segments through it.  The hits
   are the occurrences, and nothing else is known of where a window stands: the earliest hit of a window is its first
   occurrence, in whatever document, and every later one, in the same document too, repeats it.
4. Places take their segment's hits; the words that repeats cover are cut from the documents.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import SPACE_WORDS, bitmap, discard, in_bitmap, map_arrow, mix, spread, stored, text_slices, window_hashes, word_hashes, words

#: Segments that one automaton is compiled from (more only where a single anchor has more).
SHARD_SEGMENTS = 5_000
#: Bits of the map of recurring anchors: 16 for each, within these powers of two.
MAP_BITS = (16, 28)
#: An anchor is sharded by window from so many places on, or from a millionth of all places on if that is more.
HOT_PLACES = 2_000
#: Words that make one symbol of an automaton; the window size is a multiple.
GROUP = 5
#: Segments whose words a task remembers to have written (they are written again after that).
TOLD = 200_000


def _windows(data: np.ndarray, offs: np.ndarray, size: int, gram: int):
    """(word hashes, row of each word, hash of each gram, anchor of each window, window hash, window lies in one row)."""
    starts, ends, doc = words(data, offs, SPACE_WORDS)
    h = word_hashes(data, starts, ends)
    grams = window_hashes(h, gram)
    least, width, span = grams, 1, size - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :]) if len(least) > span - width else least[:0]
    n = max(0, len(h) - size + 1)
    return h, doc, grams, least[:n], window_hashes(h, size), doc[:n] == doc[size - 1 :]


def anchors(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """a: each place of words that are the anchor of a window round them.  (Equal windows that overlap have their
    anchors in different places, so a window that recurs in one run of words is counted twice as well.)"""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in text_slices(batch, "text"):
                _, _, grams, a, _, ok = _windows(data, offs, size, gram)
                place = np.zeros(len(grams), bool)
                for d in range(size - gram + 1):
                    place[d : d + len(a)] |= ok & (a == grams[d : d + len(a)])
                if place.any():
                    yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64))], ["a"])

    return map_arrow(texts.select("text"), run, "a long")


def segments(texts: DataFrame, size: int, gram: int, seen_map, hot) -> DataFrame:
    """key, seg, doc, row, pos, words of every segment with a mapped anchor; words (32-bit each, packed) are null
    where the task has written them shortly before.  texts: doc, row, text."""

    def run(batches):
        told: set[int] = set()
        for batch in batches:
            docs, rows = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, _, data, offs in text_slices(batch, "text"):
                h, doc, _, a, win, ok = _windows(data, offs, size, gram)
                n = len(a)
                if not n:
                    continue
                take = ok & in_bitmap(seen_map.value, a)
                spot = hot.value[np.minimum(np.searchsorted(hot.value, a), len(hot.value) - 1)] == a if len(hot.value) else np.zeros(n, bool)
                key = np.where(spot, win, a)
                same = np.r_[False, take[:-1] & (key[1:] == key[:-1]) & (doc[1:n] == doc[: n - 1])]
                s = np.flatnonzero(take & ~same)
                e = np.flatnonzero(take & ~np.r_[same[1:] & take[1:], False]) + size
                up, down = common._power("word", len(h))
                total = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
                seg = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
                new = np.zeros(len(s), bool)
                if len(told) > TOLD:
                    told.clear()
                for i, x in enumerate(seg.tolist()):
                    if x not in told:
                        told.add(x)
                        new[i] = True
                size_of = np.where(new, e - s, 0)
                ends = np.cumsum(size_of)
                at = np.repeat(s - (ends - size_of), size_of) + np.arange(ends[-1] if len(ends) else 0)
                packed = (h[at] >> np.uint64(32)).astype("<u4")
                body = pa.Array.from_buffers(
                    pa.large_binary(), len(s), [pa.py_buffer(np.packbits(new, bitorder="little")), pa.py_buffer(np.r_[0, ends * 4].astype(np.int64)), pa.py_buffer(packed)]
                ).cast(pa.binary())
                first = np.searchsorted(doc, np.arange(len(offs) - 1))
                r = doc[s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[s].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(docs[lo + r]), pa.array(rows[lo + r]), pa.array((s - first[r]).astype(np.int32)), body],
                    ["key", "seg", "doc", "row", "pos", "words"],
                )

    return map_arrow(texts, run, "key long, seg long, doc long, row long, pos int, words binary")


class Shard:
    """Segments of whole keys: number of places, first place (document, position), words."""

    def __init__(self, size: int):
        self.size = size
        self.places: dict[int, tuple[int, int, int]] = {}
        self.words: dict[int, bytes] = {}

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        """Three letters out of 64 for the GROUP words from each place on (the automaton looks children up one by one,
        so the alphabet has to be small); a window is size / GROUP such symbols."""
        code = (window_hashes(mix(flat.astype(np.uint64)), GROUP) >> np.uint64(46)).astype(np.int64)
        return (np.stack([code >> 12, code >> 6 & 63, code & 63], axis=1) + 32).astype(np.uint8)

    def confirmed(self, win: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A place of each distinct window that has two places or more (at: all places of windows in the words)."""
        order = np.argsort(win[at], kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(win[at[order]]) != 0])
        return at[order[new]][np.add.reduceat(times[order], new) >= 2]

    def compiled(self, letters: np.ndarray, passages: np.ndarray) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        keys = letters[passages[:, None] + np.arange(0, self.size, GROUP)].reshape(len(passages), -1)
        for i, key in enumerate(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel().astype(str).tolist()):
            automaton.add_word(key, i)
        automaton.make_automaton()
        return automaton

    def hits(self, automaton: ahocorasick.Automaton, letters: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """(segment, window's position in it, passage) of every match.  The segments are streamed once for each phase of
        the grouping, all in one string with three line feeds after each."""
        out = []
        for phase in range(GROUP):
            long = np.maximum(0, (lens - phase) // GROUP)
            ends = np.cumsum(long + 1)
            inside = np.arange(int(ends[-1])) - np.repeat(ends - long - 1, long + 1)
            seg = np.repeat(np.arange(len(lens)), long + 1)
            stream = letters[np.minimum(first[seg] + phase + inside * GROUP, len(letters) - 1)]
            stream[inside == long[seg]] = 10
            found = np.array(list(automaton.iter(stream.tobytes().decode("ascii"))), np.int64).reshape(-1, 2)
            found = found[found[:, 0] % 3 == 2]  # of whole symbols
            spot = found[:, 0] // 3
            out.append(np.stack([seg[spot], inside[spot] * GROUP + phase - (self.size - GROUP), found[:, 1]], axis=1))
        return np.concatenate(out)

    def located(self) -> np.ndarray:
        """Rows (segment, position, windows, first document, first position): runs of confirmed windows of a segment
        whose first occurrences run alongside."""
        segs = list(self.words)
        body = [np.frombuffer(self.words[s], "<u4") for s in segs]
        flat = np.concatenate(body)
        lens = np.array([len(b) for b in body])
        first = np.cumsum(lens) - lens
        times, doc, pos = np.array([self.places[s] for s in segs], np.int64).T
        win = window_hashes(mix(flat.astype(np.uint64)), self.size)
        n = lens - self.size + 1
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        passages = self.confirmed(win, at, np.repeat(times, n))
        if not len(passages):
            return np.zeros((0, 5), np.int64)
        letters = self.symbols(flat)
        found = self.hits(self.compiled(letters, passages), letters, first, lens)
        found = found[win[first[found[:, 0]] + found[:, 1]] == win[passages[found[:, 2]]]]  # the whole window, not only its symbols
        if not len(found):
            return np.zeros((0, 5), np.int64)
        seg, place, passage = found.T
        start = pos[seg] + place
        order = np.lexsort((start, doc[seg], passage))  # every passage's earliest hit
        head = np.flatnonzero(np.r_[True, np.diff(passage[order]) != 0])
        group = np.cumsum(np.r_[0, np.diff(passage[order]) != 0])
        earliest = np.empty((len(found), 2), np.int64)
        earliest[order, 0], earliest[order, 1] = doc[seg][order[head]][group], start[order[head]][group]
        order = np.lexsort((place, seg))
        seg, place, earliest = seg[order], place[order], earliest[order]
        go_on = (np.diff(seg) == 0) & (np.diff(place) == 1) & (np.diff(earliest[:, 0]) == 0) & (np.diff(earliest[:, 1]) == 1)
        head = np.flatnonzero(np.r_[True, ~go_on])
        run = np.diff(np.r_[head, len(seg)])
        return np.stack([np.array(segs)[seg[head]], place[head], run, earliest[head, 0], earliest[head, 1]], axis=1)


_RUN = ["seg", "at", "windows", "first_doc", "first_pos"]


def locate(table: DataFrame, size: int) -> DataFrame:
    """The rows of Shard.located() for all segments."""
    sums = table.groupBy("seg").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("p"))
    none = [F.lit(None).cast("long").alias(c) for c in ("n", "doc", "pos")]
    rows = sums.select("key", "seg", "n", "p.doc", F.col("p.pos").cast("long").alias("pos"), F.lit(None).cast("binary").alias("words")).unionByName(
        table.where("words is not null").select("key", "seg", *none, "words")
    )

    def run(batches):
        shard, last = Shard(size), None
        for batch in batches:
            key, seg, n, doc, pos, body = (batch.column(i).to_pylist() for i in range(6))
            for k, s, c, d, p, w in zip(key, seg, n, doc, pos, body, strict=True):
                if k != last and len(shard.words) >= SHARD_SEGMENTS:
                    yield _located(shard)
                    shard = Shard(size)
                last = k
                if w is None:
                    shard.places[s] = (c, d, p)
                else:
                    shard.words[s] = w
        if shard.words:
            yield _located(shard)

    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), run, ", ".join(f"{c} long" for c in _RUN))


def _located(shard: Shard) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in shard.located().T], _RUN)


def repeated_spans(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """row, spans: word ranges (start << 32 | end) of each row that repeat an earlier occurrence."""
    sc = texts.sparkSession.sparkContext
    counted = stored(anchors(texts, size, gram).groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    n, places = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(max(int(np.ceil(np.log2(16 * n + 1))), MAP_BITS[0]), MAP_BITS[1])
    limit = max(HOT_PLACES, places // 1_000_000)
    hot = np.sort(counted.where(F.col("n") > limit).select("a").toArrow().column("a").to_numpy().view(np.uint64))  # < a million
    table = stored(segments(texts, size, gram, sc.broadcast(bitmap(counted, "a", bits)), sc.broadcast(hot)), "segments")
    discard(counted)
    runs = stored(locate(table, size), "located")
    placed = table.select("seg", "row", "doc", "pos").join(runs, "seg")
    start = (F.col("pos") + F.col("at")).cast("long")
    repeats = placed.where((F.col("doc") != F.col("first_doc")) | (start != F.col("first_pos")))
    spans = repeats.select("row", F.shiftleft(start, 32).bitwiseOR(start + F.col("windows") + (size - 1)).alias("span"))
    return spans.groupBy("row").agg(F.collect_set("span").alias("spans"))


def remove_repeated(docs: DataFrame, size: int = 20, gram: int = 8, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if with_text) for every row of docs.

    A word is removed if it is covered by a window of `size` words whose sequence also starts earlier: in a document
    of smaller id, or earlier in the same one.  Windows are judged on the texts as given.  A null text has no words;
    a null id counts as the largest; rows of equal id count as one document, so repeated rows each keep what one
    would; an empty table gives an empty one; other columns are not read.  Texts are handled whole.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    if size % GROUP:
        raise ValueError(f"the window size must be a multiple of {GROUP}")
    texts = spread(docs).select(doc.alias("doc"), F.xxhash64(F.lit("row"), id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    spans = repeated_spans(texts, size, gram)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            n_words, n_gone, shas, texts_out = [], [], [], []
            spans_col = batch.column(2)
            for lo, hi, data, offs in text_slices(batch, "text"):
                starts, ends, doc = words(data, offs, SPACE_WORDS)
                count = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(count) - count
                delta = np.zeros(len(starts) + 1, np.int64)
                part = spans_col.slice(lo, hi - lo)
                per = np.array(part.value_lengths().fill_null(0), np.int64)
                span = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.repeat(first, per)
                np.add.at(delta, base + (span >> 32), 1)
                np.add.at(delta, base + (span & 0xFFFFFFFF), -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = np.flatnonzero(~gone)
                more = np.r_[doc[kept][1:] == doc[kept][:-1], False] if len(kept) else np.zeros(0, bool)
                # kept words and, but for a row's last, the white space byte after each
                mark = np.zeros(len(data) + 1, np.int8)
                stop = ends[kept] + more
                np.add.at(mark, starts[kept], 1)
                np.add.at(mark, stop, -1)
                keep = np.cumsum(mark[:-1], dtype=np.int8) > 0
                flat = np.where(SPACE_WORDS[data], data, np.uint8(32))[keep]
                size_of = np.bincount(doc[kept], stop - starts[kept], minlength=hi - lo).astype(np.int64)
                end = np.cumsum(size_of)
                view = memoryview(np.ascontiguousarray(flat))
                for a, b in zip((end - size_of).tolist(), end.tolist(), strict=True):
                    shas.append(hashlib.sha256(view[a:b]).hexdigest())
                    if with_text:
                        texts_out.append(bytes(view[a:b]).decode("utf-8", "replace"))
                n_words.append(count)
                n_gone.append(np.bincount(doc[gone], minlength=hi - lo))
            cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            out = [batch.column(0), cat(n_words), cat(n_gone), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts_out, pa.string())] if with_text else out, schema.names)

    fields = [T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept_text", T.StringType())] * with_text)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.lit("row"), id_col, text_col).alias("row"))
    return map_arrow(keyed.join(spans, "row", "left").select("doc_id", "text", "spans"), run, schema)
