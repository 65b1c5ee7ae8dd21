"""SimHash near-duplicates found by anchor-point covering.

A document's fingerprint is the SimHash of the set of its words: eight blocks of 23
bits. Of two fingerprints within ``THRESHOLD`` of all bits, some block differs in few: the
blocks have radii (3 for five of them and 2 for three), one more than which, added up, is
more than the threshold. The anchors cover each block to its radius: an anchor is the
block's bits under a mask, and the masks of a block are such that any difference within
the radius lies outside of one of them (Pagh, 2016: the bits are given the nonzero vectors
of r + 1 bits, and a mask has those whose product with one vector is odd; 15 masks for
radius 3, 7 for radius 2). So all pairs within the threshold meet at an anchor, on tables
of any size, and are compared there in full: none is lost. Anchors: 96 a fingerprint. The
pairs compared are some 2 % of all where bits are even, so they grow with the square of
the distinct fingerprints, whatever little a pair costs.

``wide`` asks for approximate anchors instead, of Golay codewords (2^12 words of 23 bits,
covering radius 3) of so many blocks; no query uses them.

Before that, equal fingerprints are collapsed to one, and after it the pairs are
joined into groups by connected components, so that thousands of copies cost no
more than their number. An anchor gives no more pairs than join what is near there.
Where very many meet, those around a leader are put together first: members of two
such clusters are compared only if the distance of their leaders allows a near pair.

Defined results
* null texts, texts without a word and rows without a doc_id have no fingerprint and no
  group; ``deduplicated`` keeps them;
* very long texts are read whole;
* ties: the smallest doc_id of a group stands for it;
* repeated rows, and rows that share a doc_id, are versions of one document and no
  duplicates of each other; ``deduplicated`` tells rows of one doc_id apart by their text
  and keeps every row that is no duplicate of another doc_id's;
* empty tables give empty results; extra columns, whatever their names, pass through ``deduplicated``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, key_of, stored, words_of
from .kernel import hashed_words, mix, slices

BLOCKS, WIDTH = 8, 23
BITS = BLOCKS * WIDTH
#: Fingerprints that differ in so many of the 184 bits at most are near-duplicates: what 8 % of changed words make, mean and one deviation.
THRESHOLD = 28
#: Covering radius of the code; a fingerprint goes to the anchors within it plus this.
RADIUS, EXCESS = 3, 1
#: Pairs compared at once, rows of an anchor from which on clusters are looked for first, and up to which anchors are compared side by side.
AT_ONCE, DENSE, SMALL = 1 << 20, 4096, 64
LANES = ("a", "b", "c", "d")

_POLY = 0b101011100011


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= _POLY << (i - 11)
    return word


_BASIS = np.array([_remainder(1 << i) for i in range(WIDTH)], np.int64)


def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of the nearest codeword; the patterns of more bits, up to ``EXCESS`` more than the radius, ``-1`` where there are no more."""
    nearest = np.full(2048, -1, np.int64)
    further: list[list[int]] = [[] for _ in range(2048)]
    for bits in range(RADIUS + EXCESS + 1):
        for where in itertools.combinations(range(WIDTH), bits):
            s = 0
            for i in where:
                s ^= int(_BASIS[i])
            pattern = sum(1 << i for i in where)
            if bits <= RADIUS:
                nearest[s] = pattern
            else:
                further[s].append(pattern)
    wide = max(map(len, further))
    return nearest, np.array([f + [-1] * (wide - len(f)) for f in further], np.int64)


_NEAREST, _FURTHER = _cosets()


def syndrome(block: np.ndarray) -> np.ndarray:
    s = np.zeros(block.shape, np.int64)
    for i in range(WIDTH):
        s ^= ((block >> i) & 1) * _BASIS[i]
    return s


def _expanded() -> np.ndarray:
    """For each value of a byte its bits as +1 or -1, as int8."""
    return (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int8) * 2 - 1)


_SIGNS = _expanded()


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row the blocks (rows x 8), and whether it has a word. The words of a row are parted by single spaces."""
    h, rows = hashed_words(column)
    n = len(rows) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(rows))
    if len(h):
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    starts = np.searchsorted(row, np.arange(n + 1))
    has = starts[1:] > starts[:-1]
    bits = np.zeros((n, BITS), bool)
    lanes = [h, mix(h ^ np.uint64(0x5851F42D4C957F2D)), mix(h ^ np.uint64(0x14057B7EF767814F))]
    at = starts[:-1][has]
    for k in range(BITS // 8 if len(h) else 0):
        byte = ((lanes[k // 8] >> np.uint64(8 * (k % 8))) & np.uint64(255)).astype(np.uint8)
        votes = np.add.reduceat(_SIGNS[byte].astype(np.int32), at, axis=0)
        bits[has, 8 * k : 8 * k + 8] = votes > 0
    weight = 1 << np.arange(WIDTH, dtype=np.int64)
    return (bits.reshape(n, BLOCKS, WIDTH) * weight).sum(-1), has


def _finger_batches(batches):
    for batch in batches:
        for part in slices(batch, "words"):
            blocks, has = fingerprints(part.select(["words"]).column(0))
            pick = pa.array(np.flatnonzero(has))
            b = blocks[has]
            packed = [(b[:, 2 * k] << WIDTH) | b[:, 2 * k + 1] for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), *map(pa.array, packed)], ["doc_id", "key", *LANES])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, key, a, b, c, d): the fingerprint as four integers of 46 bits."""
    words = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    return arrow_map(words, _finger_batches, "doc_id long, key long, a long, b long, c long, d long")


def _anchors(blocks: np.ndarray, wide: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the row, anchor, whether it is at home there) of all replicas; an anchor is of ``wide`` blocks."""
    s = syndrome(blocks)
    rows, keys, home = [], [], []
    for nth, chosen in enumerate(itertools.combinations(range(BLOCKS), wide)):
        at, key, near = np.arange(len(blocks), dtype=np.int64), np.full(len(blocks), nth, np.int64), np.ones(len(blocks), bool)
        for j in chosen:
            patterns = np.concatenate([_NEAREST[s[at, j]][:, None], _FURTHER[s[at, j]]], axis=1)
            which, k = np.nonzero(patterns >= 0)
            # the upper 12 bits of a codeword tell it from all others
            key = (key[which] << 12) | ((blocks[at[which], j] ^ patterns[which, k]) >> 11)
            at, near = at[which], near[which] & (k == 0)
        rows.append(at)
        keys.append(key)
        home.append(near)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _anchor_batches(wide: int):
    low = (1 << WIDTH) - 1

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000 // wide**3):
                part = batch.slice(begin, 2000 // wide**3)
                cols = [part.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                row, key, home = _anchors(np.stack([x for c in cols[1:] for x in (c >> WIDTH, c & low)], axis=1), wide)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), *(pa.array(c[row]) for c in cols)], ["anchor", "home", "doc_id", *LANES])

    return run


def covering(threshold: int) -> list[tuple[int, int]]:
    """(block, mask) of all anchors: two fingerprints within the threshold are equal in the block under one of the masks at least."""
    radius, more = divmod(threshold + 1 - BLOCKS, BLOCKS)
    out = []
    for block in range(BLOCKS):
        n = 1 << (radius + (block < more) + 1)
        # each bit's vector: all nonzero ones in turn; the rest have the top bit, so that they fall to all masks evenly
        vectors = [1 + i % (n - 1) if i < WIDTH // (n - 1) * (n - 1) else n // 2 + i % (n // 2) for i in range(WIDTH)] if n > 1 else []
        out += [(block, sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)) for v in range(1, n)]
    return out


def _covering_batches(threshold: int):
    low, anchors = (1 << WIDTH) - 1, covering(threshold)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                cols = [part.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                blocks = [x for c in cols[1:] for x in (c >> WIDTH, c & low)]
                key = np.concatenate([(blocks[block] & mask) | nth << WIDTH for nth, (block, mask) in enumerate(anchors)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(len(key), bool)), *(pa.array(np.tile(c, len(anchors))) for c in cols)], ["anchor", "home", "doc_id", *LANES])

    return run


def _beside(lanes: list[np.ndarray], begin: np.ndarray, at: np.ndarray, threshold: int):
    """Near pairs of rows ``at`` and rows before them at the same anchor, which begins at ``begin``."""
    lag = 1
    while True:
        at = at[at - lag >= begin[at]]
        if not len(at):
            return
        far = sum(np.bitwise_count(c[at] ^ c[at - lag]) for c in lanes[:2])
        some = at[far <= threshold]
        some = some[sum(np.bitwise_count(c[some] ^ c[some - lag]) for c in lanes) <= threshold]
        if len(some):
            yield some, some - lag
        lag += 1


def _near(here: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: int):
    """Pairs of rows (one of x, one of y) within the threshold, block by block."""
    step = max(1, AT_ONCE // max(len(y), 1))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        far = sum(np.bitwise_count(c[part, None] ^ c[None, y]) for c in here[:2])
        # half of the bits cannot differ in more places than all do: none is lost here
        i, j = np.nonzero(far <= threshold)
        i, j = part[i], y[j]
        good = (i != j) & (sum(np.bitwise_count(c[i] ^ c[j]) for c in here) <= threshold)
        if good.any():
            yield i[good], j[good]


def _clustered(here: list[np.ndarray], threshold: int):
    """Near pairs that join all that is near at a dense anchor: each cluster to its leader, and what is near outside of one cluster."""
    n = len(here[0])
    left, clusters, idle = np.arange(n), [], 0
    while len(left) and idle < 32:
        # leaders from all over the anchor, whatever the order
        leader = left[(len(left) * (2 * len(clusters) + 2 * idle + 1) // 128) % len(left)]
        far = sum(np.bitwise_count(c[leader] ^ c[left]) for c in here)
        own = far <= threshold
        if own.sum() < max(32, len(left) // 256):
            idle += 1
            continue
        idle = 0
        clusters.append((leader, left[own], int(far[own].max())))
        left = left[~own]
    for leader, members, _ in clusters:
        yield np.full(len(members) - 1, leader), members[members != leader]
    for k, (one, members, r) in enumerate(clusters):
        for two, others, q in clusters[:k]:
            # no member of one can be near a member of the other if the leaders are further apart than this
            if sum(int(np.bitwise_count(c[one] ^ c[two])) for c in here) <= r + q + threshold:
                yield from _near(here, members, others, threshold)
    yield from _near(here, left, np.arange(n), threshold)


def _met_batches(threshold: int, joining: bool):
    """The near pairs of the anchors of a partition, which has all rows of each of them; if ``joining``, as many as join them."""

    def run(batches):
        parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)] for batch in batches if batch.num_rows]
        if not parts:
            return
        cols = [np.concatenate([p[k] for p in parts]) for k in range(7)]
        del parts
        order = np.lexsort((~cols[1], cols[0]))  # at each anchor what is at home comes first
        anchor, home, ids, *lanes = (c[order] for c in cols)
        edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        at_home = np.add.reduceat(home.astype(np.int64), edges[:-1])
        found, size = [], 0
        rows = np.diff(edges)
        # small anchors whose rows are all at home are compared side by side, the others one by one
        small = (at_home == rows) & (rows <= SMALL)

        def pairs():
            yield from _beside(lanes, np.repeat(edges[:-1], rows), np.flatnonzero(np.repeat(small, rows)), threshold)
            for begin, end, n in zip(edges[:-1][~small].tolist(), edges[1:][~small].tolist(), at_home[~small].tolist()):
                if not n or end - begin < 2:
                    continue
                here = [c[begin:end] for c in lanes]
                for x, y in _clustered(here, threshold) if joining and end - begin > DENSE else _near(here, np.arange(n), np.arange(end - begin), threshold):
                    yield begin + x, begin + y

        for x, y in pairs():
            one, two = ids[x], ids[y]
            both = np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)
            found.append(_tree(both) if joining and len(both) > 4096 else both)
            size += len(found[-1])
            if size > AT_ONCE:
                found = [_tree(np.concatenate(found)) if joining else np.unique(np.concatenate(found), axis=0)]
                size = 0
        if found:
            both = np.concatenate(found)
            both = _tree(both) if joining else np.unique(both, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])

    return run


def near_pairs(fingers: DataFrame, threshold: int = THRESHOLD, joining: bool = False, wide: int | None = None) -> DataFrame:
    """(x, y), x < y: ids of all distinct fingerprints within ``threshold`` bits of each other; if ``joining``, only pairs
    that join the same documents. ``wide`` is for approximate anchors, of so many blocks."""
    there = arrow_map(fingers.select("doc_id", *LANES), _anchor_batches(wide) if wide else _covering_batches(threshold), "anchor long, home boolean, doc_id long, a long, b long, c long, d long")
    return arrow_map(there.repartition("anchor"), _met_batches(threshold, joining), "x long, y long").distinct()


def _tree(both: np.ndarray) -> np.ndarray:
    """Pairs (x, y), x the smallest of a tree, that join what the pairs join: by labels that sink along the pairs."""
    nodes, place = np.unique(both, return_inverse=True)
    place = place.reshape(both.shape)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[place[:, 0]], label[place[:, 1]])
        new = label.copy()
        # a root takes the least label that any of its nodes meets
        np.minimum.at(new, label[place[:, 0]], least)
        np.minimum.at(new, label[place[:, 1]], least)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[leaf]], nodes[leaf]], axis=1)


def _forest(batches):
    """Of the pairs of a partition, a forest that joins the same documents: each to the smallest of its tree."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        size += len(held[-1])
        if size > AT_ONCE:
            held = [_tree(np.concatenate(held))]
            size = 0
    if held:
        both = _tree(np.concatenate(held))
        for k in range(0, len(both), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[k : k + 50_000, 0]), pa.array(both[k : k + 50_000, 1])], ["x", "y"])


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component: large-star and small-star steps
    (Kiveris et al., 2014) until nothing changes."""
    edges = checkpointed(arrow_map(pairs.select("x", "y"), _forest, "x long, y long").distinct())
    while True:
        both = edges.select("x", "y").union(edges.select(F.col("y"), F.col("x")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("x"), "y").where("x <> y").distinct()
        # every edge now runs from a smaller to a larger node; small star joins a node's smaller ones
        least = large.groupBy("y").agg(F.min("x").alias("m"))
        small = large.join(least, "y").select(F.col("m"), F.col("x"), F.col("y"))
        new = small.select(F.col("m").alias("x"), F.explode(F.array("x", "y")).alias("y")).where("x <> y").distinct()
        new = checkpointed(new)
        # done when each node has one edge and no root is a leaf
        leaves = new.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        wrong = leaves.where("n > 1").select("y").union(new.select("x").join(leaves.select(F.col("y").alias("x")), "x", "left_semi")).limit(1).count()
        edges = new
        if not wrong:
            break
    return edges.select(F.col("y").alias("node"), F.col("x").alias("root"))


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, key, duplicate_of) of each row that belongs to a group and not to its smallest document."""
    fingers = stored(fingerprinted(docs), "fingerprints")
    one = stored(fingers.groupBy(*LANES).agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    # a fingerprint's number stands for it, as rows of one doc_id may have several
    one = stored(one.withColumn("node", F.xxhash64(*LANES)), "nodes")
    roots = components(near_pairs(one.select(F.col("node").alias("doc_id"), *LANES), threshold, joining=True)).withColumnRenamed("node", "__n")
    member = one.join(roots, one["node"] == roots["__n"], "left").select(*LANES, "doc_id", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("duplicate_of"))
    owner = member.drop("doc_id").join(least, "root").select(*LANES, "duplicate_of")
    return fingers.join(owner, list(LANES)).where("doc_id <> duplicate_of").select("doc_id", "key", "duplicate_of").distinct()


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): each document that belongs to a group and is not its smallest, and the smallest. Where rows
    that share a doc_id belong to several groups, there is a row for each."""
    return _grouped(docs, threshold).select("doc_id", "duplicate_of").distinct()


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of documents that stand for their group or have none, with all their columns."""
    gone = _grouped(docs, threshold).select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key"))
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (key_of(docs["text"]) == gone["__key"]), "left_anti")
