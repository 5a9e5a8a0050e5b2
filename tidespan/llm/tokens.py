"""Token counts by rank-synchronous merging of byte-level pairs in ragged numpy arrays.

All pre-tokens of a batch lie in one flat array of symbols with a segment number each.  A round finds every
segment's lowest-ranked adjacent pair with one reduction and merges all its places in all segments at once; a
segment that has no ranked pair left is done and leaves the arrays.  In a trained vocabulary a merged symbol only
occurs in pairs of higher rank than its own, so a round equals the usual one-at-a-time order.

Long pre-tokens (text without spaces) would take a round per rank over all their symbols.  They keep their places by
rank instead: a round takes the places of the lowest rank alone, in all long segments at once, and files the new
pairs beside the merged symbols, so the work grows with the number of merges.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spread

#: Unicode White_Space, spelled out because libraries differ on the control characters 1C-1F.
_WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2000))) + "-" + chr(0x200A)
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_TWO_SPACES = re.compile(r"\s\s|^\s|\s$")
_NONE = np.int64(1 << 40)
#: Counts of this many distinct space-separated chunks are kept by a Python worker before it starts afresh.
CACHE_CHUNKS = 300_000
#: Pre-tokens of more bytes than this are merged by way of places filed by rank.
LONG_BYTES = 400


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies use for the 256 bytes: the byte itself if it is
    printable in Latin-1, else the next code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """The merge table of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.start = np.zeros(256, np.int64)
        for ch, b in byte_alphabet().items():
            self.start[b] = vocab[ch]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.cache: dict[str, int] = {}
        self.split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each piece survive all merges."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = lens.copy()
        long = np.flatnonzero(lens > LONG_BYTES)
        if len(long):
            out[long] = self.merged_long([pieces[i] for i in long.tolist()])
        ids = np.flatnonzero((lens > 1) & (lens <= LONG_BYTES))
        sym = self.start[np.frombuffer(b"".join(p for p in pieces if 1 < len(p) <= LONG_BYTES), np.uint8)]
        lens = lens[ids]
        while len(ids):
            ends = np.cumsum(lens)
            rank = np.empty(len(sym), np.int64)
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[ends - 1] = _NONE
            best = np.minimum.reduceat(rank, ends - lens)
            going = best < _NONE
            out[ids[~going]] = lens[~going]
            at = np.flatnonzero(rank == np.repeat(np.where(going, best, -1), lens))
            if len(at):  # of a run of overlapping places (equal symbols) every second one merges
                fresh = np.r_[True, np.diff(at) != 1]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
                sym[at] = self.made[rank[at]]
                keep = np.repeat(going, lens)
                keep[at + 1] = False
                gone = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(ids))
                sym, lens, ids = sym[keep], (lens - gone)[going], ids[going]
            else:
                break
        return out

    def merged_long(self, pieces: list[bytes]) -> np.ndarray:
        """The same, by places filed by rank."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        n, ends = len(sym), np.cumsum(lens)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lens] = n, -1  # n and -1: no neighbour
        now = np.full(n, _NONE)  # rank of the pair that starts here; of no pair where the symbol is gone
        filed: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[after[at] < n]
            now[at] = self.rank(sym[at], sym[after[at]])
            at = at[now[at] < _NONE]
            at = at[np.argsort(now[at], kind="stable")]
            ranks = now[at]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for part in np.split(at, cut) if len(at) else ():
                r = int(now[part[0]])
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(heap, r)
                filed[r].append(part)

        file(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(filed.pop(r)))
            at = at[now[at] == r]
            if not len(at):
                continue
            fresh = np.r_[True, after[at[:-1]] != at[1:]]  # of overlapping places every second one merges
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            now[at] = now[gone] = _NONE
            left = before[at]
            file(np.unique(np.r_[at, left[left >= 0]]))
            sym[gone] = -1
        return np.add.reduceat((sym >= 0).astype(np.int64), ends - lens)

    def chunks(self, text: str) -> list[str]:
        """Cut text where pre-tokens end for certain: before a single space between other characters."""
        if _TWO_SPACES.search(text):
            return _PRETOKEN.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's string counts as one, as the library has it by default."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        known, rows = self.cache, []
        for text in texts:
            parts, extra = [text], 0
            if self.split is not None and any(s in text for s in self.specials):
                parts = self.split.split(text)
                extra = len(parts) - 1
            rows.append(([c for p in parts if p for c in self.chunks(p)], extra))
        new = list({c for cs, _ in rows for c in cs if c not in known})
        if new:
            cut = [_PRETOKEN.findall(c) for c in new]
            counts = self.merged([p.encode("utf-8", "surrogatepass") for ps in cut for p in ps])
            ends = np.cumsum([len(ps) for ps in cut])
            total = np.r_[0, np.cumsum(counts)]
            known.update(zip(new, (total[ends] - total[np.r_[0, ends[:-1]]]).tolist(), strict=True))
        return [extra + sum(map(known.__getitem__, cs)) for cs, extra in rows]


_mergers: dict[str, RankMerger] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs.

    path: a byte-level BPE file in the tokenizers library's JSON format, present on every executor.  A null text
    counts as empty (0 tokens, not over the limit); a null id stays null; repeated rows each give a row; an empty
    table gives an empty one; other columns are not read.  No shuffle: one pass, in slices of about 2 MB.
    """

    def run(batches):
        if path not in _mergers:
            _mergers[path] = RankMerger(path)
        merger = _mergers[path]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            counts, sizes, group, held = [], [], [], 0
            for value in texts:
                text = value.as_py() or ""
                group.append(text)
                held += len(text)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                if held > 1 << 20:
                    counts += merger.count(group)
                    group, held = [], 0
            counts += merger.count(group)
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.array(sizes, np.int64)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )
    return map_arrow(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), run, schema)
