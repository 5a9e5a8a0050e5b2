"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit decreasing.

Only a histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the driver.  There a
bin pattern is fixed for as many bins as its lengths last; the plan is a short table of patterns with counts.
Pieces then get a rank within their length, and the plan turns rank into sequence and offset, so no task ever
holds all pieces of a length.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spread, stored, text_slices, word_hashes

#: Distinct words whose ids a Python worker keeps by default before it starts afresh.
CACHE_WORDS = 1_000_000
#: Bytes of text that are split and encoded together.
ENCODED_TOGETHER = 1 << 21
#: Pieces of one length that are ranked in one window group, on average, and the most groups that a length is cut into.
RANKED_TOGETHER, MOST_GROUPS = 500, 100_000


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix item sets that provably dominate every other set for their largest item; count is lowered in place.

    Returns (number of bins, [(length, copies), ...]).  For the largest item L with room R = capacity - L and the
    other items left: alone if nothing fits; with the largest fitting item M if M = R, or if no two items fit
    together, or if at most two fit and M >= the best pair; with the best pair (a, b) if a = M and at most one
    item lies strictly between b and a.  Removing items never invalidates such a set, so it is fixed as often as
    its items last.
    """
    fixed = []
    for big in range(capacity, 0, -1):
        while count[big]:
            count[big] -= 1
            sizes = np.flatnonzero(count)
            count[big] += 1
            room = capacity - big
            fits = sizes[sizes <= room]
            if not len(fits):
                chosen = []
            else:
                low = np.repeat(fits[:3], np.minimum(count[fits[:3]] - (fits[:3] == big), 3))[:3]
                most = int(fits[-1])
                if most == room or len(low) < 2 or low[0] + low[1] > room:
                    chosen = [most]
                elif len(low) == 3 and low.sum() <= room:
                    break  # three or more fit: nothing is known
                else:
                    a, b = best_pair(count, fits, big, room)
                    if most >= a + b:
                        chosen = [most]
                    elif a == most and between(count, b, a, big) <= 1:
                        chosen = [a, b]
                    else:
                        break
            need = Counter([big, *chosen])
            bins = min(int(count[x]) // n for x, n in need.items())
            if chosen and bins == 0:
                break
            for x, n in need.items():
                count[x] -= bins * n
            fixed.append((bins, sorted(need.items(), reverse=True)))
    return fixed


def best_pair(count: np.ndarray, fits: np.ndarray, big: int, room: int) -> tuple[int, int]:
    """The two items a >= b of largest total within room."""
    i, j, best = 0, len(fits) - 1, (0, 0)
    while i <= j:
        total = int(fits[i] + fits[j])
        alone = i == j and count[fits[i]] - (fits[i] == big) < 2
        if total <= room:
            if total > sum(best) and not alone:
                best = (int(fits[j]), int(fits[i]))
            i += 1
        else:
            j -= 1
    return best


def between(count: np.ndarray, b: int, a: int, big: int) -> int:
    return int(count[b + 1 : a].sum()) - (b < big < a)


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing over the histogram: equal items fill equal bins as a group."""
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for size in range(capacity, 0, -1):
        left = int(count[size])
        for room in sorted(r for r in bins if r >= size):
            each = room // size
            while left and bins.get(room):
                n, items = bins[room].pop()
                full = min(n, left // each)
                if full:
                    bins.setdefault(room - each * size, []).append((full, [*items, (size, each)]))
                    left -= full * each
                    n -= full
                if n and left:
                    bins.setdefault(room - left * size, []).append((1, [*items, (size, left)]))
                    n, left = n - 1, 0
                if n:
                    bins[room].append((n, items))
                    break
            if not left:
                break
        if left:
            each = capacity // size
            if left >= each:
                bins.setdefault(capacity - each * size, []).append((left // each, [(size, each)]))
            if left % each:
                bins.setdefault(capacity - left % each * size, []).append((1, [(size, left % each)]))
    return [group for groups in bins.values() for group in groups]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, copies per sequence, first offset) in that order."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] = n
    groups = reduce_dominated(count, capacity) + best_fit(count, capacity)
    used, rows, sequence = Counter(), [], 0
    for bins, items in groups:
        offset = 0
        for size, copies in items:
            rows.append((size, used[size], used[size] + bins * copies, sequence, copies, offset))
            used[size] += bins * copies
            offset += size * copies
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


class HashIndex:
    """64-bit hashes to entry numbers, in two sorted arrays (a dictionary of strings takes ten times the memory)."""

    def __init__(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], np.int32(-1))

    def add(self, keys: np.ndarray, first: int) -> None:
        """New keys, numbered from first."""
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.entry = keys[order], np.concatenate([self.entry, np.arange(first, first + len(keys) - len(self.entry), dtype=np.int32)])[order]


class Ids:
    """Rows of token ids, one after the other."""

    def __init__(self) -> None:
        self.ids, self.at, self.len = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.at = np.concatenate([self.at, (len(self.ids) + np.cumsum(lens) - lens).astype(np.int32)])
        self.len, self.ids = np.concatenate([self.len, lens.astype(np.int32)]), np.concatenate([self.ids, ids])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids, and the end of each."""
        size = self.len[rows]
        ends = np.cumsum(size)
        src = np.repeat(self.at[rows] - (ends - size).astype(np.int32), size)
        src += np.arange(len(src), dtype=np.int32)
        return self.ids[src], ends


class WordEncoder:
    """Token ids by way of a cache of space-separated words; no pre-token of the vocabulary spans a space.

    Letters (of Latin-1) and a run of stops or commas are pre-tokens of their own, so a word of that form is put together from
    its letters' ids and the run's.  Letters new to the cache are encoded joined by spaces, many at once: the
    vocabulary's tokens that end a pre-token carry a mark, by which the result is cut.  All other words are encoded
    one by one.
    """

    def __init__(self, path: str, end_id: int, cache_words: int = CACHE_WORDS):
        self.end_id, self.cache_words = end_id, cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all words; entry 0 is the end of a text."""
        self.words, self.parts = HashIndex(), HashIndex()
        self.word_ids, self.part_ids = Ids(), Ids()
        self.word_ids.add(np.array([self.end_id], np.uint32), np.ones(1, np.int64))

    def one_by_one(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and each word's number of them."""
        got = [e.ids for lo in range(0, len(new), 1000) for e in self.tok.encode_batch_fast(new[lo : lo + 1000], add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def joined(self, new: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words whose numbers of pre-tokens are known."""
        out = []
        for lo in range(0, len(new), 500):
            group = new[lo : lo + 500]
            ids = np.array(self.tok.encode(" ".join(group), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum(parts[lo : lo + 500])
            if len(ends) == last[-1] and ends[-1] == len(ids):
                out.append((ids, np.diff(ends[last - 1], prepend=0)))
            else:
                out.append(self.one_by_one(group))
        ids, lens = zip(*out, strict=True) if out else ((np.zeros(0, np.uint32),), (np.zeros(0, np.int64),))
        return np.concatenate(ids), np.concatenate(lens)

    def part_entries(self, parts: list[str], encode) -> np.ndarray:
        """Entries of parts, those that are new encoded first."""
        keys = np.fromiter(map(hash, parts), np.int64, len(parts)).view(np.uint64)
        got = self.parts.find(keys)
        if len(missing := np.flatnonzero(got < 0)):
            fresh, first = np.unique(keys[missing], return_index=True)
            ids, lens = encode([parts[i] for i in missing[first].tolist()])
            self.parts.add(fresh, len(self.part_ids.len))
            self.part_ids.add(ids, lens)
            got = self.parts.find(keys)
        return got

    def learn(self, new: list[str]) -> np.ndarray:
        """Encode words and return their entries: those of letters, perhaps with stops or commas after them, by way of
        their letters in lower case, which most of them share with other words; the rest as they stand."""
        cores, tails, simple = [], [], np.zeros(len(new), bool)
        for i, w in enumerate(new):
            core = w.rstrip(".,")
            if core.isalpha() and (core.isascii() or max(core) <= "\xff"):  # beyond, lower case or NFC may part letters
                simple[i] = True
                tails.append(w[len(core) :])
                cores.append(core.lower())
        letters = self.part_entries(cores, lambda x: self.joined(x, np.ones(len(x), np.int64)))
        both = np.stack([letters, self.part_entries(tails, self.one_by_one)], axis=1).ravel()
        ids, ends = self.part_ids.take(both)
        first = len(self.word_ids.len)
        self.word_ids.add(ids, np.diff(ends[1::2], prepend=0))
        self.word_ids.add(*self.one_by_one([w for w, s in zip(new, simple.tolist(), strict=True) if not s]))
        entry = np.empty(len(new), np.int32)
        entry[np.r_[np.flatnonzero(simple), np.flatnonzero(~simple)]] = np.arange(first, first + len(new), dtype=np.int32)
        return entry

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, the end id after each, and each text's number of ids."""
        if len(self.words.keys) > self.cache_words:
            self.clear()
        data = np.where(data == 10, np.uint8(32), data)
        texts = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(data)])
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        own = coded.dictionary
        raw, at = own.buffers()[2], np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1]
        keys = word_hashes(np.frombuffer(raw, np.uint8)[: at[-1]] if raw is not None else np.zeros(0, np.uint8), at[:-1], at[1:])
        entry = self.words.find(keys)
        if len(missing := np.flatnonzero(entry < 0)):
            entry[missing] = self.learn(own.take(pa.array(missing)).to_pylist())
            order = np.argsort(entry[missing])
            self.words.add(keys[missing][order], int(entry[missing].min()))
        code = entry[coded.indices.to_numpy()]
        ids, ends = self.word_ids.take(np.insert(code, split.offsets.to_numpy()[1:], 0))  # and the end of each text
        return ids, np.diff(ends[split.offsets.to_numpy()[1:] + np.arange(len(offs) - 1)], prepend=0)


_encoders: dict[tuple[str, int, int], WordEncoder] = {}


def tokenized_pieces(
    docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, resident: bool = True, together: int = ENCODED_TOGETHER
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a document's ids and end_id, cut at capacity."""

    def run(batches):
        key = (path, end_id, cache_words)
        enc = _encoders.get(key) or WordEncoder(*key)
        if resident:
            _encoders[key] = enc
        for batch in batches:
            out = []
            for lo, _, data, offs in text_slices(batch, "text", together):
                ids, per = enc.encode(data, offs)
                ends = np.cumsum(per)
                pieces = -(-per // capacity)
                row = np.repeat(np.arange(lo, lo + len(per)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(np.repeat(per, pieces) - start, capacity)
                first = np.repeat(ends - per, pieces) + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                out.append((row, piece, start, length, np.array(crc, np.int64)))
            if out:
                rows = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0])), pa.array(rows[1].astype(np.int32)), *map(pa.array, rows[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, long) for c in ("start", "length", "ids_crc32")]]
    )
    return map_arrow(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), run, schema)


def assign(pieces: DataFrame, rows: np.ndarray, counts: dict[int, int]) -> DataFrame:
    """Add sequence_id and offset: rank each piece within its length, then look the rank up in the plan.  A length with
    many pieces is ranked in groups, and a group's ranks follow those of the groups before it."""
    hot = [(size, min(math.ceil(n / RANKED_TOGETHER), MOST_GROUPS)) for size, n in counts.items() if n > RANKED_TOGETHER]
    table = pa.table({"length": pa.array([h[0] for h in hot], pa.int64()), "_groups": pa.array([h[1] for h in hot], pa.int64())})
    groups = F.broadcast(pieces.sparkSession.createDataFrame(table))  # at most capacity rows; of a list, it would take Python workers of their own
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.coalesce("_groups", F.lit(1)))
    salted = pieces.join(groups, "length", "left").select(*pieces.columns, salt.alias("_salt"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(sizes, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rank") - 1).alias("_rank"))
    key = rows[:, 0] << 44 | rows[:, 1]

    def run(batches):
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = rows[np.searchsorted(key, size << 44 | rank, "right") - 1] if len(rows) else np.zeros((0, 6), np.int64)
            nth = rank - at[:, 1]
            seq, off = at[:, 3] + nth // at[:, 4], at[:, 5] + nth % at[:, 4] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*b.schema.names[:-1], "sequence_id", "offset"])

    long = T.LongType()
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", long), T.StructField("offset", long)])
    return map_arrow(ranked, run, schema)


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, resident: bool = True, together: int = ENCODED_TOGETHER
) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is the
    single id end_id; a document over capacity is cut into full pieces and a rest; a null id stays null; repeated
    rows are packed as documents of their own; an empty table gives no rows; other columns are not read.  path: a
    tokenizers JSON file whose pre-tokens never span white space, present on every executor.

    cache_words: distinct words whose ids a worker keeps, some 60 bytes each, for speed; resident: whether it keeps them
    when a task has ended, for the next one; together: bytes of text encoded at a time.
    """
    pieces = stored(tokenized_pieces(docs, path, capacity, end_id, id_col, text_col, cache_words, resident, together), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    return assign(pieces, plan(counts, capacity), counts)
