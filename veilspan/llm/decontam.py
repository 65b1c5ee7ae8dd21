"""Benchmark decontamination by a stored FM-index of each training shard.

A shard is a run of documents on end. All its words become symbols (their rank among
the shard's own words); a void before each document, smaller than any word, parts it
from the last. The suffixes are sorted in full, and the Burrows-Wheeler transform goes
into a wavelet tree (in its level-wise form, the wavelet matrix, as packed bit planes).
``indexed`` gives a row a shard, which can be stored and searched again with any other
test set.

The test phrases are the runs of ``N`` words of each benchmark item, or the whole item
if it is shorter. They are searched in parts of about ``PHRASES`` at a time, whatever
their number, each part backwards together; what they hit is located by walking back to
a sampled suffix. Overlapping and touching hits of a document merge to one removal span.

Defined results
* null and empty texts have no span; null or empty items give no phrase;
* null doc_id: ``spans`` leaves the row out, ``cleaned`` cuts its text like any other;
* very long texts are searched whole, in a shard of their own if need be;
* ties: a span that several items cover names the smallest item_id;
* repeated rows: each row of a document is searched; equal spans of one doc_id are one;
  rows that share a doc_id but not the text are cut each by its own spans;
* empty tables: no spans; extra columns pass through ``cleaned``, whatever their names.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, key_of, ship, stored, words_of
from .kernel import bytes_of, hashed_words, slices

#: Words of a test phrase; a shorter item is one phrase.
N = 8
#: Bytes of text to a shard.
SHARD_BYTES = 5 << 20
#: Every so many positions of a shard are kept as suffix samples.
SAMPLE = 16
#: Phrases searched at once: what the driver and each task hold.
PHRASES = 1 << 18


class WaveletTree:
    """Rank over a sequence of integers: a packed bit plane a level, ones counted by words of 64 bits."""

    def __init__(self, n: int, planes: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.levels, self.planes, self.ones, self.zeros = n, len(planes), planes, ones, zeros

    @staticmethod
    def of(seq: np.ndarray, levels: int) -> WaveletTree:
        n, wide = len(seq), len(seq) // 64 + 1
        planes, ones, zeros = np.zeros((levels, wide), np.uint64), np.zeros((levels, wide), np.uint32), np.zeros(levels, np.int64)
        seq = seq.astype(np.uint32)
        for k, level in enumerate(range(levels - 1, -1, -1)):
            bit = ((seq >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes[k].view(np.uint8)[: len(packed)] = packed
            np.cumsum(np.bitwise_count(planes[k][:-1]), out=ones[k][1:])
            zeros[k] = n - int(bit.sum())
            if level:
                seq = np.concatenate([seq[~bit], seq[bit]])
        return WaveletTree(n, planes, ones, zeros)

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word].astype(np.int64) + np.bitwise_count(self.planes[k][word] & low)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before each of two positions."""
        base = np.zeros_like(low)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            b, lo, hi = (self._rank1(k, x) for x in (base, low, high))
            zeros = self.zeros[k]
            base, low, high = np.where(bit, zeros + b, base - b), np.where(bit, zeros + lo, low - lo), np.where(bit, zeros + hi, high - hi)
        return low - base, high - base

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and how often each occurs before its position."""
        low, at, symbol = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for k in range(self.levels):
            bit = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            low1, at1 = self._rank1(k, low), self._rank1(k, at)
            low = np.where(bit, self.zeros[k] + low1, low - low1)
            at = np.where(bit, self.zeros[k] + at1, at - at1)
            symbol = (symbol << 1) | bit
        return symbol, at - low


class FMIndex:
    """Index of a sequence of symbols: 0 is never searched, each 0 is a symbol of its own, smaller than all others."""

    def __init__(self, tree: WaveletTree, begin: np.ndarray, void_before: np.ndarray, stops: np.ndarray, samples: np.ndarray):
        self.tree, self.begin, self.void_before, self.stops, self.samples = tree, begin, void_before, stops, samples
        self.sampled = np.concatenate([[0], np.cumsum(np.unpackbits(stops, bitorder="little")[: tree.n], dtype=np.int32)])

    @staticmethod
    def of(seq: np.ndarray, sigma: int, sample: int = SAMPLE) -> FMIndex:
        suffix = _suffixes(seq)
        before = np.where(suffix == 0, 0, seq[suffix - 1])
        counts = np.bincount(seq, minlength=sigma + 1)[: sigma + 1]
        counts[0] = 0
        begin = np.concatenate([[0], np.cumsum(counts)])  # row where a symbol's suffixes begin, zeros left out
        # of each symbol, how often a zero follows it: those suffixes come first among its own
        void_before = np.bincount(seq[np.append(seq[1:] == 0, True)], minlength=sigma + 1)[: sigma + 1]
        stop = (suffix % sample == 0) | (before == 0)
        return FMIndex(WaveletTree.of(before, max(1, int(sigma).bit_length())), begin, void_before, np.packbits(stop, bitorder="little"), suffix[stop].astype(np.int32))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase. ``phrases`` is padded on the left; the last symbols are at the right."""
        width = phrases.shape[1]
        last = phrases[:, -1]
        low, high = self.begin[last].copy(), self.begin[last + 1].copy()
        for k in range(1, width):
            at = np.flatnonzero((lengths > k) & (low < high))
            if not len(at):
                break
            s = phrases[at, width - 1 - k]
            base = self.begin[s] + self.void_before[s]
            lo, hi = self.tree.rank(s, low[at], high[at])
            low[at], high[at] = base + lo, base + hi
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, steps, at = np.full(len(rows), -1, np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            stop = self.sampled[at + 1] > self.sampled[at]
            out[open_[stop]] = self.samples[self.sampled[at[stop]]] + steps
            open_, at = open_[~stop], at[~stop]
            symbol, rank = self.tree.access(at)
            at = self.begin[symbol] + self.void_before[symbol] + rank
            steps += 1
        return out


def _suffixes(seq: np.ndarray) -> np.ndarray:
    """Where the suffixes that begin with a symbol other than 0 stand, in order."""
    n = len(seq)
    void = seq == 0
    n_void = int(void.sum())
    where = np.flatnonzero(~void)
    if not len(where):
        return where
    bits = np.uint64(max(1, int(seq.max()).bit_length()))
    first = 64 // int(bits)  # symbols to a first key
    padded = np.concatenate([seq.astype(np.uint64), np.zeros(first, np.uint64)])
    key, alive = padded[where].copy(), np.ones(len(where), bool)
    for k in range(1, first):
        s = padded[where + k]
        alive &= s != 0
        key = (key << bits) | np.where(alive, s, 0)
    # runs that a void ends are told apart by its place, which a stable sort keeps
    order = np.argsort(key, kind="stable")
    suffix, key, ended = where[order], key[order], ~alive[order]
    new = np.ones(len(suffix), bool)
    new[1:] = (key[1:] != key[:-1]) | ended[1:] | ended[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[:-1][void] = np.arange(n_void)
    rank[n] = -1
    rank[suffix] = n_void + np.maximum.accumulate(np.where(new, np.arange(len(suffix)), 0))
    open_, step = np.flatnonzero(~(new & np.append(new[1:], True))), first
    while len(open_):
        which = suffix[open_]
        head = rank[which]
        tail = rank[np.minimum(which + step, n)]
        order = np.lexsort((tail, head))
        which, head, tail = which[order], head[order], tail[order]
        suffix[open_] = which
        fresh = np.ones(len(which), bool)
        fresh[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        # a new group's rank is the row where it begins
        rank[which] = n_void + np.maximum.accumulate(np.where(fresh, open_, 0))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return suffix


class ShardIndex:
    """The FM-index of a shard's documents with their words; ``dump`` and ``load`` keep it as bytes."""

    def __init__(self, words: np.ndarray, heads: np.ndarray, index: FMIndex):
        self.words, self.heads, self.index = words, heads, index

    @staticmethod
    def of(h: np.ndarray, rows: np.ndarray) -> ShardIndex:
        """``h``: hashes of the words of all documents; ``rows``: where each document's begin."""
        n = len(rows) - 1
        words, symbol = np.unique(h, return_inverse=True)
        seq = np.zeros(len(h) + n, np.int64)
        seq[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(rows)) + 1] = symbol + 1
        return ShardIndex(words, rows[:-1] + np.arange(n), FMIndex.of(seq, len(words)))

    def dump(self) -> bytes:
        f, tree = io.BytesIO(), self.index.tree
        np.savez(f, words=self.words, heads=self.heads.astype(np.uint32), n=np.int64(tree.n), planes=tree.planes, ones=tree.ones, zeros=tree.zeros,
                 begin=self.index.begin.astype(np.uint32), void_before=self.index.void_before.astype(np.uint32), stops=self.index.stops, samples=self.index.samples)
        return f.getvalue()

    @staticmethod
    def load(raw: bytes) -> ShardIndex:
        x = np.load(io.BytesIO(raw), allow_pickle=False)
        long = lambda name: x[name].astype(np.int64)
        tree = WaveletTree(int(x["n"]), x["planes"], x["ones"], x["zeros"])
        return ShardIndex(x["words"], long("heads"), FMIndex(tree, long("begin"), long("void_before"), x["stops"], x["samples"]))

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence."""
        at = np.searchsorted(self.words, phrases.words)
        at = np.minimum(at, max(len(self.words) - 1, 0))
        symbol = np.where(self.words[at] == phrases.words, at + 1, 0) if len(self.words) else np.zeros(len(at), np.int64)
        table = np.where(phrases.table > 0, symbol[phrases.table - 1], -1)
        there = np.flatnonzero((table != 0).all(1))  # a phrase with a word that the shard lacks is nowhere
        low, high = self.index.search(np.maximum(table[there], 0), phrases.lengths[there])
        times = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(low)), times)
        row = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
        where = self.index.locate(row)
        doc = np.searchsorted(self.heads, where, side="right") - 1
        return doc, where - self.heads[doc] - 1, there[which]


class Phrases:
    """Test phrases as arrays, picklable: each a run of places among the distinct words, padded on the left by 0."""

    def __init__(self, hashes: list[np.ndarray], items: np.ndarray):
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.items = items
        self.words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        width, at = int(self.lengths.max()), np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.zeros((len(hashes), width), np.int64)
        for k in range(width):
            has = self.lengths > k
            self.table[has, width - 1 - k] = place[at[1:][has] - 1 - k] + 1


def phrases_of(benchmark: DataFrame) -> DataFrame:
    """(phrase array<string>, item_id): distinct test phrases, each with the smallest item that has it."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.split(words_of(F.col("text")), " ").alias("w"))
    size = F.size("w")
    starts = F.when(size >= N, F.sequence(F.lit(1), size - N + 1)).when(F.col("w")[0] != "", F.array(F.lit(1)))
    grams = items.where(starts.isNotNull()).select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), N).alias("phrase"))
    return grams.groupBy("phrase").agg(F.min("item_id").alias("item_id"))


def _index_batches(batches):
    task, n = TaskContext.get().partitionId(), 0

    def done(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        h, rows = hashed_words(whole.column(2).combine_chunks())
        list_of = lambda c: pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c).combine_chunks())
        arrays = [pa.array([f"{task:06d}-{n:06d}"]), pa.array([len(h)], pa.int64()), list_of(0), list_of(1), pa.array([ShardIndex.of(h, rows).dump()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["shard", "n_words", "doc_ids", "keys", "index"])

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "words", SHARD_BYTES // 4):
            held.append(part)
            size += int(np.ptp(bytes_of(part.column(2))[1]))
            if size >= SHARD_BYTES:
                yield done(held)
                held, size, n = [], 0, n + 1
    if held:
        yield done(held)


def indexed(docs: DataFrame) -> DataFrame:
    """(shard, n_words, doc_ids, keys, index): a row for each shard of the documents that have an id and a text."""
    words = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    return arrow_map(words, _index_batches, "shard string, n_words long, doc_ids array<long>, keys array<long>, index binary")


def _searching(phrases: Phrases):
    names = ["doc_id", "key", "start", "end", "item_id"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids, keys = (one.column(c).flatten().to_numpy() for c in (0, 1))
                d, start, which = ShardIndex.load(one.column(2)[0].as_buffer().to_pybytes()).find(phrases)
                if not len(d):
                    continue
                end, item = start + phrases.lengths[which], phrases.items[which]
                order = np.lexsort((end, start, d))
                d, start, end, item = d[order], start[order], end[order], item[order]
                # running end within a document; a later document's are moved beyond every earlier end
                far = np.int64(1 << 40)
                reach = np.maximum.accumulate(end + d * far)
                new = np.ones(len(d), bool)
                new[1:] = (start[1:] + d[1:] * far) > reach[:-1]
                at = np.flatnonzero(new)
                found = (ids[d[at]], keys[d[at]], start[at], np.maximum.reduceat(end, at), np.minimum.reduceat(item, at))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names)

    return run


def _merged(hits: DataFrame) -> DataFrame:
    """Merge (doc_id, key, start, end, item_id) that overlap or touch."""
    w = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("g", F.sum("new").over(w))
    return marked.groupBy("doc_id", "key", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("item_id").alias("item_id")).drop("g")


def _hash_batches(batches):
    for batch in batches:
        h, rows = hashed_words(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(h.view(np.int64))), *batch.columns[1:]], ["h", "item_id", "part"])


_SCHEMA = "doc_id long, key long, start long, end long, item_id long"


def searched(index: DataFrame, benchmark: DataFrame, at_once: int = PHRASES) -> DataFrame:
    """(doc_id, key, start, end, item_id) of the removal spans in an index of ``indexed``; it is best stored, as it is read once for each part of the phrases."""
    spark = index.sparkSession
    phrases = stored(phrases_of(benchmark), "phrases")
    count = phrases.count()
    if not count:
        return spark.createDataFrame([], _SCHEMA)
    parts = -(-count // at_once)
    dealt = phrases.select(F.array_join("phrase", " ").alias("phrase"), "item_id", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int").alias("part"))
    hashes = stored(arrow_map(dealt, _hash_batches, "h array<long>, item_id long, part int"), "phrase-hashes")
    out = None
    for part in range(parts):
        got = hashes.where(F.col("part") == part).orderBy("h").toArrow().combine_chunks()  # about ``at_once`` of them
        if not got.num_rows:
            continue
        rows = got.column("h").combine_chunks()
        at, flat = rows.offsets.to_numpy(), rows.flatten().to_numpy().view(np.uint64)
        found = arrow_map(index.select("doc_ids", "keys", "index"), _searching(Phrases(np.split(flat, at[1:-1] - at[0]), got.column("item_id").to_numpy())), _SCHEMA)
        if parts > 1:
            found = stored(found, "hits")
        out = found if out is None else out.unionByName(found)
    # rows with one doc_id and one text have the same spans
    return (out if parts == 1 else _merged(out.distinct())).distinct()


def spans(docs: DataFrame, benchmark: DataFrame, at_once: int = PHRASES) -> DataFrame:
    """(doc_id, start, end, item_id): words [start, end) of a document are benchmark text."""
    return searched(stored(indexed(docs), "fm-index"), benchmark, at_once).select("doc_id", "start", "end", "item_id").distinct()


_WORD = regex.compile(r"[\p{L}\p{N}]+")


def cut(text: str, cuts: list[tuple[int, int]]) -> str:
    """``text`` without the words of the (disjoint) spans and what lies between their words."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in sorted(cuts):
        out.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


def _cut_all(text: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([t if c is None or t is None else cut(t, [(x["start"], x["end"]) for x in c]) for t, c in zip(text, cuts)], dtype=object)


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the spans cut from ``text`` and ``n_chars`` (if there) set anew; documents without a span are untouched."""
    id_, key = (lambda d: F.coalesce(d["doc_id"].cast("long"), key_of(d["text"]))), (lambda d: key_of(d["text"]))
    named = docs.select(id_(docs).alias("doc_id"), docs["text"].alias("text"))
    found = searched(stored(indexed(named), "fm-index"), benchmark).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("__cuts"))
    found = stored(found.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__cuts"), "removal-spans")
    ship(docs.sparkSession)
    out = docs.join(found, (id_(docs) == found["__id"]) & (key(docs) == found["__key"]), "left")
    out = out.withColumn("__new", F.pandas_udf(_cut_all, "string")(docs["text"], found["__cuts"]))
    changed = F.col("__cuts").isNotNull()
    return out.select(*(
        F.when(changed, F.col("__new")).otherwise(docs["text"]).alias("text") if c == "text"
        else F.when(changed, F.length("__new").cast(t)).otherwise(docs["n_chars"]).alias("n_chars") if c == "n_chars"
        else docs[c]
        for c, t in docs.dtypes
    ))
