"""Near-duplicate documents by a chosen-path set similarity join.

Every document's set (its distinct k-word shingles) is sketched by minwise tokens.  A tree starts with all documents
in one node; at each node the path chooses one or two of the sketch's coordinates and branches on their tokens, so
similar sets are likely to stay together and others part.  A node of few documents and shingles is compared
exhaustively; a larger one branches on.  Independent trees repeat this, and components are taken of the links found.

What is still too large after the deepest level is dealt into blocks that also hold the node's pivots, the same for
all its blocks: that joins most of a mass of near copies.  What that leaves apart is then compared with everything in
the node, block by block, so no pair of a node is lost to its size.

A comparison first looks at one bit of each coordinate, then at the full sets of what is likely to be similar.  Most
documents with a likely partner have the same ones in every tree: of blocks that come down to the same documents only
one is compared, so a set seldom moves more than once.  A block gives the links that span its components; pairs within
a component are neither compared nor written out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE_WORDS, bitmap, discard, in_bitmap, map_arrow, mix, spread, stored, text_slices, window_hashes, without, word_hashes, words
from .components import components

COORDINATES = 256
_rng = np.random.default_rng(8)
_A = _rng.integers(1, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(1, 2**32, COORDINATES, dtype=np.uint32)


def shingle_sets(batch: pa.RecordBatch, column: str, k: int):
    """The sorted distinct shingle hashes of every row; A-Z count as lower case, words are [^\\x20\\x09-\\x0D]+."""
    for lo, hi, data, offs in text_slices(batch, column):
        data = LOWER[data]
        starts, ends, doc = words(data, offs, SPACE_WORDS)
        h = word_hashes(data, starts, ends)
        count = np.bincount(doc, minlength=hi - lo)
        first = np.cumsum(count) - count
        win = window_hashes(h, k)
        for n, at in zip(count.tolist(), first.tolist(), strict=True):
            if n >= k:
                yield np.unique(win[at : at + n - k + 1])
            elif n:  # fewer words: the whole sequence is the one shingle
                yield window_hashes(h[at : at + n], n) ^ np.uint64(n)
            else:
                yield h[:0]


def sketch(s: np.ndarray) -> np.ndarray:
    """The token of each coordinate: the lower 16 bits of the least of its hash over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for lo in range(0, len(s), 128):
        np.minimum(least, (x[lo : lo + 128] * _A + _B).min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2")  # the upper bits of a least value are nearly all 0


def paths(sigs: np.ndarray, trees: int, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(document, node numbers by level) of every way that the sketched documents take down the trees.

    At each node the path itself chooses the coordinates: one, and a second one so often that 1 / similarity are
    chosen on average, which keeps the expected number of shared nodes of a pair at that similarity at one."""
    second = np.uint64(int((1 / similarity - 1) * 2**32))
    n = len(sigs)
    doc = np.tile(np.arange(n), trees)
    at = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64)), n)
    levels: list[np.ndarray] = []
    for level in range(depth):
        r0 = mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
        r1 = mix(at * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level + 77))
        c1 = (r0 % np.uint64(COORDINATES)).astype(np.int64)
        c2 = (c1 + 1 + (r1 % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        both = np.flatnonzero((r1 >> np.uint64(32)) < second)
        pick = np.r_[np.arange(len(doc)), both]
        c = np.r_[c1, c2[both]]
        doc = doc[pick]
        node = mix(at[pick] ^ (c.astype(np.uint64) << np.uint64(33)) ^ (sigs[doc, c].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)))
        levels = [x[pick] for x in levels] + [node]
        at = node
    return doc, np.stack(levels, axis=1)


def sketched(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit fingerprint of the set; null if it is empty), sig."""

    def run(batches):
        for batch in batches:
            n, k1, k2, sig = [], [], [], []
            for s in shingle_sets(batch, "text", k):
                n.append(len(s))
                if len(s):
                    k1.append(int(mix(s).sum()) % 2**64 - 2**63)
                    k2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) % 2**64 - 2**63)
                    sig.append(sketch(s).tobytes())
                else:
                    k1.append(None), k2.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    long = T.LongType()
    schema = T.StructType([T.StructField(c, long) for c in ("doc_id", "n_shingles", "k1", "k2")] + [T.StructField("sig", T.BinaryType())])
    return map_arrow(spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), run, schema)


def nodes(reps: DataFrame, trees: int, depth: int, similarity: float) -> DataFrame:
    """rid, n (shingles) and path (node numbers by level) for every way down every tree."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, COORDINATES)
                doc, way = paths(sig, trees, depth, similarity)
                own = [part.column(i).take(pa.array(doc)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(way[:, i].view(np.int64)) for i in range(depth)]], ["rid", "n", *[f"n{i}" for i in range(depth)]])

    return map_arrow(reps.select("rid", "n", "sig"), run, "rid long, n long, " + ", ".join(f"n{i} long" for i in range(depth)))


def _pieces(size: Column, weight: Column, leaf: int, leaf_shingles: int) -> Column:
    return F.greatest(F.ceil(size / leaf), F.ceil(weight / leaf_shingles)).cast("long")


def grouped_nodes(ways: DataFrame, depth: int, leaf: int, leaf_shingles: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(node, block, rid) to compare, and (node, rid, n) of the nodes that are too large at the deepest level; both
    stored.  Nodes of one document vanish; those of up to leaf documents and leaf_shingles shingles are a block; larger
    ones branch on, and at the last level are dealt into blocks that all hold the node's pivots."""
    parts, temporary, going = [], [], ways
    fits = (F.col("size") <= leaf) & (F.col("weight") <= leaf_shingles) | (F.col("size") == 2)
    for level in range(depth):
        members = going.select(F.col(f"n{level}").alias("node"), "rid", "n").distinct()
        sizes = stored(members.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1"), "node_sizes")
        parts.append(members.join(sizes.where(fits), "node").select("node", F.lit(0).cast("long").alias("block"), "rid"))
        large = sizes.where(~fits)
        temporary.append(sizes)
        if level + 1 < depth:
            going = stored(going.join(large.select(F.col("node").alias(f"n{level}")), f"n{level}", "left_semi"), "going_on")
            temporary.append(going)
            continue
        rest = stored(members.join(large, "node"), "large_members")
        temporary.append(rest)
        blocks = _pieces(F.col("size"), F.col("weight"), leaf, leaf_shingles)
        parts.append(rest.select("node", F.pmod(F.xxhash64("node", "rid"), blocks).alias("block"), "rid"))
        first = rest.groupBy("node").agg(*[F.min(F.xxhash64(F.lit(p), "rid", "node")).alias(f"h{p}") for p in range(pivots)])
        chosen = rest.join(first, "node").where(" or ".join(f"xxhash64({p}, rid, node) = h{p}" for p in range(pivots)))
        parts.append(chosen.select("node", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "rid"))
    out = stored(reduce(DataFrame.unionByName, parts).distinct(), "nodes"), stored(rest.select("node", "rid", "n"), "large_nodes")
    discard(*temporary)
    return out


def left_apart(large: DataFrame, leaf: int, leaf_shingles: int) -> DataFrame:
    """(node, block, rid, comp) that bring every two documents of a node together that are in different components.
    large: node, rid, n, comp.  The documents of a node's largest component meet all the others, and these each other;
    pairs within the largest component, usually nearly all of a mass of copies, don't meet."""
    comps = large.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    node = comps.groupBy("node").agg(F.max(F.struct("c", "comp", "w")).alias("m"), F.sum("c").alias("size"), F.sum("w").alias("weight")).where("size > m.c")
    half, shingles = max(leaf // 2, 1), max(leaf_shingles // 2, 1)
    node = node.select(
        "node",
        F.col("m.comp").alias("main"),
        _pieces(F.col("m.c"), F.col("m.w"), half, shingles).alias("a"),
        _pieces(F.col("size") - F.col("m.c"), F.col("weight") - F.col("m.w"), half, shingles).alias("b"),
    )
    dealt = large.join(node, "node").withColumn("_main", F.col("comp") == F.col("main"))
    h = F.xxhash64("rid", "node")
    dealt = dealt.withColumn("p", F.when(F.col("_main"), F.col("b") + F.pmod(h, F.col("a"))).otherwise(F.pmod(h, F.col("b"))))
    last = F.when(F.col("_main"), F.col("b")).otherwise(F.col("a") + F.col("b")) - 1
    met = dealt.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("p != q")
    return met.select("node", (F.least("p", "q") * (F.col("a") + F.col("b")) + F.greatest("p", "q")).alias("block"), "rid", "comp")


def similar_bits(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows of one-bit sketches (words of 64) have an estimated similarity of least or more.  Unequal
    tokens still agree in a bit half of the time, so the similarity is 1 - 2 * differing bits / COORDINATES."""
    most = int((1 - least) / 2 * COORDINATES)
    apart = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return apart <= most


def by_block(rows: DataFrame, each, schema: str) -> DataFrame:
    """Call each(table) for every block (node, block) of rows; tables arrive sorted, so only one block is held."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                yield from cut([*held, batch], held, False)
        if held:
            yield from cut(held[:], held, True)

    def cut(parts: list[pa.RecordBatch], held: list[pa.RecordBatch], last: bool):
        """All whole blocks in parts; the last one may go on in the next batch and is held back."""
        t = pa.Table.from_batches(parts).combine_chunks()
        key = np.stack([t.column("node").to_numpy(), t.column("block").to_numpy()], axis=1)
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts, stops = np.r_[0, edge].tolist(), np.r_[edge, len(key)].tolist()
        whole = len(starts) if last else len(starts) - 1
        held[:] = [] if last else t.slice(starts[-1]).to_batches()
        out = [x for a, b in zip(starts[:whole], stops[:whole], strict=True) if b - a > 1 and (x := each(t.slice(a, b - a))) is not None]
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return map_arrow(rows.repartition("node", "block").sortWithinPartitions("node", "block"), run, schema)


def _bits(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("bits").to_pylist()), "<u8").reshape(-1, COORDINATES // 64)


def likely_members(blocks: DataFrame, least: float) -> DataFrame:
    """(node, block, rid, comp, bits, same): the documents of blocks that have a likely partner of another component in
    their block; same is a hash of them all.  blocks: node, block, rid, comp (the rid itself where nothing is known),
    bits."""

    def each(t: pa.Table) -> pa.Table | None:
        bits, comp = _bits(t), t.column("comp").to_numpy()
        if (comp == comp[0]).all():
            return None
        has = np.zeros(len(bits), bool)
        for lo in range(0, len(bits), 256):
            has[lo : lo + 256] = (similar_bits(bits[lo : lo + 256], bits, least) & (comp[lo : lo + 256, None] != comp)).any(axis=1)
        if not has.any():
            return None
        t = t.filter(pa.array(has)).select(["node", "block", "rid", "comp", "bits"])
        rid, comp = (t.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("rid", "comp"))
        same = mix(mix(rid) + comp).sum().astype(np.uint64).view(np.int64)
        return t.append_column("same", pa.array(np.full(len(t), same)))

    return by_block(blocks, each, "node long, block long, rid long, comp long, bits binary, same long")


def linked(members: DataFrame, percent: int, least: float) -> DataFrame:
    """(u, v): confirmed links that span each block's components.  members: node, block, rid, comp, bits,
    set; documents of equal comp are in one component already.

    A document is compared, on full sets, with every likely partner that isn't in its component yet: no pair within
    a component is looked at, and no pairs are written out but those that join two components.
    """

    def each(t: pa.Table) -> pa.Table | None:
        rid, bits = t.column("rid").to_numpy(), _bits(t)
        sets = [np.frombuffer(x, "<u8") for x in t.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        code = np.split(flat, ends[:-1])
        _, label = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        mark, out = np.zeros(int(flat.max()) + 1, bool), []
        for lo in range(0, len(rid), 256):
            near = similar_bits(bits[lo : lo + 256], bits, least)
            for i in range(lo, min(lo + 256, len(rid))):
                js = np.flatnonzero(near[i - lo] & (label != label[i]))
                js = js[js > i]
                js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
                if not len(js):
                    continue
                mark[code[i]] = True
                n = size[js]
                at = np.repeat(ends[js] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(n) - n)
                mark[code[i]] = False
                for j in js[100 * shared >= percent * (size[i] + n - shared)].tolist():
                    if label[j] != label[i]:
                        out.append((rid[i], rid[j]))
                        label[label == label[j]] = label[i]
        if not out:
            return None
        u, v = zip(*out, strict=True)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return by_block(members, each, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """rid, set of the documents (rid, text) that ids may hold: a bit map of bounded size picks them without moving
    any text; the few others that share a bit do no harm."""
    hashed = ids.select(F.xxhash64("rid").alias("h"))
    bits = min(max(int(np.ceil(np.log2(16 * hashed.count() + 1))), 16), 28)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(hashed, "h", bits))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy().view(np.uint64))))
            if batch.num_rows:
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch, "text", k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rid", "set"])

    picked = map_arrow(docs.where("rid is not null").withColumn("h", F.xxhash64("rid")), run, "rid long, set binary")
    return picked.dropDuplicates(["rid"])


def screen(percent: int, errors: float) -> float:
    """The estimated similarity from which full sets are compared: so many standard errors of the estimate (one bit of
    each of COORDINATES coordinates) under the threshold."""
    apart = (1 - percent / 100) / 2
    return percent / 100 - errors * 2 * math.sqrt(apart * (1 - apart) / COORDINATES)


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    k: int = 5,
    trees: int = 6,
    depth: int = 2,
    leaf: int = 1024,
    leaf_shingles: int = 1 << 21,
    pivots: int = 4,
    errors: float = 4.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles; component_id is
    the least id reachable, itself included; kept: doc_id is component_id.  A pair at a threshold of 0.85 shares a node
    of a tree's first level with a chance of 0.87 and of the second with one of about 0.78 (at 0.80: 0.84 and 0.73), so
    six trees miss about one in ten thousand of those whose nodes are large, fewer of others; the screen by bits, the
    same in all trees, misses another three in a hundred thousand at `errors` = 4.  More similar pairs are missed less.

    leaf, leaf_shingles: documents and shingles that one task compares at a time (a single pair of longer documents may
    have more).  In a node over leaf, documents left out of its largest component are compared with all of it, at a
    cost of their number times the node's size.

    A null or empty text has an empty set and is linked with nothing.  Rows with equal sets are linked without a
    comparison; rows with equal ids are one vertex.  A row with a null id is grouped with equal sets only, its
    component is the least id among those (null if none) and kept is component_id <=> doc_id.  Other columns are not
    read; an empty table gives an empty one.
    """
    least = screen(percent, errors)
    base = stored(sketched(docs, k, id_col, text_col), "sketches")
    classes = base.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rid"))
    classes = stored(classes, "classes")
    same = (base.k1 == classes.k1) & (base.k2 == classes.k2) & (base.doc_id == classes.rid)
    reps = base.join(classes, same).select("rid", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["rid"])
    reps = stored(reps, "representatives")

    def one_bit(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, COORDINATES)
                bits = np.packbits(sig >> 8 & 1, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in bits], pa.binary())], ["rid", "bits"])

    ways = stored(nodes(reps, trees, depth, percent / 100), "ways")
    members, large = grouped_nodes(ways, depth, leaf, leaf_shingles, pivots)
    discard(ways)
    bits = stored(map_arrow(reps.select("rid", "sig"), one_bit, "rid long, bits binary"), "bits")
    texts = docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("text"))

    def compared(blocks: DataFrame, name: str) -> DataFrame:
        chosen = stored(likely_members(blocks.join(bits, "rid").select("node", "block", "rid", "comp", "bits"), least), f"likely{name}")
        once = chosen.groupBy("same").agg(F.min(F.struct("node", "block")).alias("m")).select("m.*", "same")
        sets = full_sets(texts, chosen.select("rid").distinct(), k)
        links = stored(linked(chosen.join(once, ["node", "block", "same"], "left_semi").join(sets, "rid"), percent, least), f"links{name}")
        discard(chosen)
        return links

    links = compared(members.withColumn("comp", F.col("rid")), "")
    comp = components(links)
    if not large.isEmpty():
        have = comp.withColumnRenamed("id", "rid").withColumnRenamed("component", "comp")
        known = large.join(have, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        apart = stored(left_apart(known, leaf, leaf_shingles), "left_apart")
        if not apart.isEmpty():
            more = compared(apart, "_apart")
            if not more.isEmpty():
                comp = components(comp.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
            discard(more)
        discard(apart)
    discard(members, large, bits, reps, links)
    labels = classes.join(comp.withColumnRenamed("id", "rid"), "rid", "left").select("k1", "k2", F.coalesce("component", "rid").alias("_c"))
    empty = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    other = base.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2").join(labels, ["k1", "k2"]).select("doc_id", "n_shingles", F.col("_c").alias("component_id"))
    return empty.unionByName(other).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80, trees: int = 8) -> DataFrame:
    """docs with one document of each near-duplicate group, the one of least id; rows with a null id or text stay, rows
    of equal id go together, other columns don't matter, an empty table gives an empty one."""
    gone = near_duplicates(docs, percent, trees=trees).where("not kept and doc_id is not null")
    return without(docs, stored(gone.select("doc_id").distinct(), "duplicates"))
