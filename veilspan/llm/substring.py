"""Near-duplicate passages by compact windows.

The tokens are shingles of ``SHINGLE`` words. For each of ``HASHES`` hash functions the
Cartesian tree over a document's shingle hashes gives the compact windows (l, c, r):
every stretch within [l, r] that contains c has its minimum at c. Only windows wide
enough for a passage of ``LEAST`` words are kept; their centres are the minima of all
stretches of that width, and their bounds the next smaller centres on either side, so
only those nodes of the tree are ever made.

Windows with the same minimum under the same function meet. The words around a centre
are cut into ``SIDE`` blocks on either side; where, is told by the words (``CUT``), so
that the blocks past an insertion or deletion are the same again. Within a slice of a task
windows with the same ``2 * SIDE`` blocks are copies: they are linked to the one of the
smallest doc_id and not sent on, so a passage that a third of all documents have costs a
row a slice and not a row a document. The others meet by one shuffle, all of a minimum in
one task, and copies among them are treated alike. Each other window is linked, for every
set of blocks that it shares with an earlier one, to the first that has the set: so many
blocks before and so many after the centre, and the same with an edit on either side,
past which ``SURE`` blocks agree again. What two windows share is so found at the one
that stands for it, however many others share less; a group costs rows and never pairs.

Links of the same two documents along one diagonal are joined to intervals and verified
by their words: a word agrees if it stands in a run of three that are the same in both
documents, at the links' distance or up to ``SLACK`` words off, so insertions and
deletions do no harm. Stretches of agreeing words, with gaps of up to ``GAP`` words, are
passages if they have ``SPAN`` words and ``SIMILAR`` of them agree. What comes out is
verified word by word, so one function is enough (``MIN_HASHES``); ``functions`` says how
many led to a passage.

Defined results
* null, empty and short texts (under LEAST words), and rows without a doc_id, have no span;
* very long texts are read whole;
* ties: of equal minima within a document the leftmost is the centre; the source is the
  smallest doc_id among those that the window met;
* repeated rows, and rows that share a doc_id, are one document: passages that repeat only within a document are not reported;
* empty tables give empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, maybe_in, stored, words_of
from .kernel import bytes_of, hashed_words, mix, slices

#: Words of the shortest passage looked for.
LEAST = 50
SHINGLE, HASHES, MIN_HASHES = 6, 4, 1
#: One word in so many begins a block, words of a block at most, blocks kept on either side of a centre, blocks that agree past an edit, and blocks that an edit makes of one at most.
CUT, BLOCK, SIDE, SURE, EDITED = 5, 12, 8, 3, 3
#: Words off a link's distance that still count, words of a gap, and what makes a passage: its words, and the share that agrees.
SLACK, GAP, SPAN, SIMILAR = 4, 6, 40, 0.75
#: Words around the links of an interval that are compared, and words of a chunk and between two.
MARGIN, STEP, CHUNK = 72, 256, 768
#: Bytes of text within which links are made before the shuffle.
SLICE = 8 << 20

_SALT = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917]
_BASE = 0x9E3779B97F4A7C15


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def _nearest_smaller(value: np.ndarray, fence: np.ndarray, step: int) -> np.ndarray:
    """Index of the nearest smaller value in one direction, or of the fence (an index that stops the search)."""
    to = np.arange(len(value)) + step
    open_ = np.arange(len(value))
    while True:
        inside = (to[open_] - fence[open_]) * step < 0
        open_ = open_[inside]
        open_ = open_[value[to[open_]] > value[open_]]
        if not len(open_):
            break
        to[open_] = to[to[open_]]
    return np.where((to - fence) * step < 0, to, fence)


def compact_windows(g: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, l, c, r) of all windows at least ``width`` shingles wide; row k has the shingles [begin[k], end[k])."""
    empty = np.zeros(0, np.int64)
    n = len(g)
    if n < width:
        return empty, empty, empty, empty
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (g & ~low) | np.arange(n, dtype=np.uint64)
    least, size = packed, 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n - width + 1], least[width - size : n - size + 1])
    valid = np.zeros(n - width + 2, np.int32)
    has = end - begin >= width
    np.add.at(valid, begin[has], 1)
    np.add.at(valid, end[has] - width + 1, -1)
    least = least[np.cumsum(valid[:-1]) > 0]
    if not len(least):
        return empty, empty, empty, empty
    # the stretches with one centre are adjacent
    least = least[np.append(True, least[1:] != least[:-1])]
    c = (least & low).astype(np.int64)
    row = np.searchsorted(begin, c, side="right") - 1
    first = np.searchsorted(row, row, side="left")
    last = np.searchsorted(row, row, side="right")
    left = _nearest_smaller(least, first - 1, -1)
    right = _nearest_smaller(least, last, 1)
    l = np.where(left >= first, c[np.maximum(left, 0)] + 1, begin[row])
    r = np.where(right < last, c[np.minimum(right, len(c) - 1)] - 1, end[row] - 1)
    return row, l, c, r


def _first_of(group: np.ndarray) -> np.ndarray:
    """Where the first row with the same value is."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64)
    if group.dtype == np.int64 and group.min() >= 0 and group.max() < n:  # numbers of rows need no sort
        head = np.empty(n, np.int64)
        head[group[::-1]] = np.arange(n - 1, -1, -1)
        return head[group]
    # the upper bits of a hash and the row, sorted as one number, are the stable order if equal upper bits are equal hashes
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    packed = (group.view(np.uint64) & ~low) | np.arange(n, dtype=np.uint64)
    packed.sort()
    by = (packed & low).view(np.int64)
    fresh = np.append(True, (packed[1:] ^ packed[:-1]) > low)
    value = group[by]
    other = value[1:] != value[:-1]
    if (other != fresh[1:]).any():
        by = np.argsort(group, kind="stable")
        value = group[by]
        fresh = np.append(True, value[1:] != value[:-1])
    head = np.empty(n, np.int64)
    first = np.flatnonzero(fresh)
    head[by] = by[first].repeat(np.diff(np.append(first, n)))
    return head


def _hashed(*columns: np.ndarray) -> np.ndarray:
    out = columns[0].view(np.uint64)
    for c in columns[1:]:
        out = mix(out ^ mix(c.view(np.uint64) + np.uint64(_BASE)))
    return out


class _Blocks:
    """The blocks of a run of words: cut where a word's hash says so, and after ``BLOCK`` words at the latest."""

    def __init__(self, h: np.ndarray):
        at = np.arange(len(h) + 1)
        cut = np.append(mix(h ^ np.uint64(_BASE)) % np.uint64(CUT) == 0, True)
        self.before = np.concatenate([[0], np.maximum.accumulate(np.where(cut, at, 0))[:-1]])  # the last cut before a word
        self.after = np.concatenate([np.minimum.accumulate(np.where(cut, at, len(h))[::-1])[::-1][1:], [len(h)]])
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(h) + 1, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(len(h) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])

    def beside(self, at: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
        """A byte for each of the ``SIDE`` blocks from word ``at`` on, in one direction, the nearest lowest; 0 for those that do not end within the document."""
        packed = np.zeros(len(at), np.uint64)
        for j in range(SIDE):
            to = np.maximum(self.before[at], at - BLOCK) if step < 0 else np.minimum(self.after[at], at + BLOCK)
            inside = (edge - to) * step > 0
            low, high = (to, at) if step < 0 else (at, to)
            value = mix((self.sums[high] - self.sums[low]) * self.inverse[low]) % np.uint64(255) + np.uint64(1)
            packed |= np.where(inside, value, np.uint64(0)) << np.uint64(8 * j)
            at = np.where(inside, to, at)
        return packed.view(np.int64)


#: What is shuffled goes in parcels: the rows of one of so many parts as one binary, so that the engine moves few rows.
PARTS = 1 << 15
_PARCEL = "part int, rows binary"
_WINDOW = np.dtype([("key", "<i8"), ("doc_id", "<i8"), ("place", "<i8"), ("before", "<i8"), ("after", "<i8"), ("source_doc", "<i8"), ("source_c", "<i4")])
_LINK = np.dtype([("doc_id", "<i8"), ("source_doc", "<i8"), ("c", "<i4"), ("source_c", "<i4"), ("fn", "i1")])
#: Bytes of rows that are put into parcels at once.
PARCELS = 64 << 20


def _parcels(kind: np.dtype, columns: list[np.ndarray], by: np.ndarray):
    """The rows of the columns, all of one value of ``by`` in the same part."""
    part = (mix(by.view(np.uint64)) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part = part[order]
    rows = np.empty(len(order), kind)
    for name, column in zip(kind.names, columns, strict=True):
        rows[name] = column[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    at = np.append(first, len(part)).astype(np.int32) * np.int32(kind.itemsize)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(rows.tobytes())])
    yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), blobs], ["part", "rows"])


def _opened(kind: np.dtype, batches) -> np.ndarray:
    """All rows of the parcels of a partition."""
    parts = [bytes_of(batch.column(1))[0] for batch in batches if batch.num_rows]
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)


def _window_batches(least: int, hashes: int):
    width = least - SHINGLE + 1

    def run(batches):
        for batch in batches:
            for part in slices(batch, "words", SLICE):
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
                ids = part.column(0).to_numpy()
                h, rows = hashed_words(part.column(1))
                sh = runs_of(h, SHINGLE)
                if not len(sh):
                    continue
                begin = np.minimum(rows[:-1], len(sh))
                end = np.maximum(np.minimum(rows[1:] - SHINGLE + 1, len(sh)), begin)
                blocks = _Blocks(h)
                made = []
                for k in range(hashes):
                    g = mix(sh ^ np.uint64(_SALT[k]))
                    row, _, c, _ = compact_windows(g, begin, end, width)
                    if not len(c):
                        continue
                    sides = [blocks.beside(c, rows[row], -1), blocks.beside(c + SHINGLE, rows[row + 1], 1)]
                    key, doc, at = mix(g[c] ^ np.uint64(k)), ids[row], c - rows[row]
                    head = _first_of(_hashed(key, *sides))
                    linked = doc[head] != doc
                    # a linked row goes anywhere, as nothing is left to be met
                    key = np.where(linked, _hashed(doc, at.astype(np.int64)), key).view(np.int64)
                    sides = [np.where(linked, 0, s) for s in sides]
                    place = at.astype(np.int64) | np.int64(k) << np.int64(40)
                    made.append((key, doc, place, *sides, doc[head], np.where(linked, at[head], -1)))
                if made:
                    columns = [np.concatenate(x) for x in zip(*made)]
                    for begin in range(0, len(columns[0]), PARCELS // _WINDOW.itemsize):
                        some = [x[begin : begin + PARCELS // _WINDOW.itemsize] for x in columns]
                        yield from _parcels(_WINDOW, some, some[0])

    return run


def _words(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))


def windows(docs: DataFrame, least: int = LEAST, hashes: int = HASHES) -> DataFrame:
    """Parcels of (key, doc_id, place, before, after, source_doc, source_c): a compact window by its centre, ``place`` being its
    shingle and, from bit 40 on, its function; the blocks around it; and the window of the same slice that it is linked to
    (``source_c`` is -1 if to none)."""
    return arrow_map(_words(docs), _window_batches(least, hashes), _PARCEL)


def _narrowed(side: np.ndarray, group: np.ndarray):
    """(rows, head) by set of blocks of one side: the rows that share it with another of their group, and which of these is the first
    of them. The sets are the first k blocks, and the first k with the ``SURE`` next ones past 1 to ``EDITED`` others, for all k. Rows
    that all share the next block as well are left to the larger set."""
    byte = [(side >> (8 * j)) & 255 for j in range(SIDE)]

    def shared(rows, group):
        head = _first_of(group) if len(rows) else rows
        size = np.bincount(head, minlength=len(rows))[head]
        some = size > 1
        # heads have others with them, so they are among the rows that are left
        return rows[some], (np.cumsum(some) - 1)[head[some]], size[some]

    rows, head, size = shared(np.arange(len(side)), group)
    for k in range(SIDE + 1):
        narrower = rows[:0], head[:0], size[:0]
        if k < SIDE:
            ok = np.flatnonzero(byte[k][rows])
            narrower = shared(rows[ok], _hashed(head[ok], byte[k][rows[ok]]))
            largest = np.zeros(len(side), np.int64)
            largest[narrower[0]] = narrower[2]
            open_ = np.flatnonzero(largest[rows] < size)
        else:
            open_ = np.arange(len(rows))
        rows, head = rows[open_], (np.cumsum(np.bincount(open_, minlength=len(head))) - 1)[head[open_]]
        if len(rows):
            yield rows, head
            past = [(np.flatnonzero(byte[k + e + SURE - 1][rows]), k + e) for e in range(1, min(EDITED, SIDE - SURE - k) + 1)]
            if past:
                classes = np.concatenate([_hashed(head[ok], *(byte[b + j][rows[ok]] for j in range(SURE))) for ok, b in past])
                ok = np.concatenate([ok for ok, _ in past])
                order = np.argsort(ok, kind="stable")  # the first of a class stays the first
                rows, head, _ = shared(rows[ok[order]], classes[order])
                if len(rows):
                    yield rows, head
        rows, head, size = narrower


def _link_batches(batches):
    """Parcels of (doc_id, source_doc, c, source_c, fn), by document: what ``_linked`` tells."""
    told, size = [], 0
    for columns in _linked(_opened(_WINDOW, batches)):
        told.append(columns)
        size += len(columns[0]) * _LINK.itemsize
        if size > PARCELS:
            yield from _told(told)
            told, size = [], 0
    if size:
        yield from _told(told)


def _told(told: list[tuple[np.ndarray, ...]]):
    columns = [np.concatenate(x) for x in zip(*told)]
    for begin in range(0, len(columns[0]), PARCELS // _LINK.itemsize):
        some = [x[begin : begin + PARCELS // _LINK.itemsize] for x in columns]
        yield from _parcels(_LINK, some, some[0])


def _linked(rows: np.ndarray):
    """(doc_id, source_doc, c, source_c, fn) of the windows of a partition, which has all rows of each minimum."""

    def told(doc, place, source, at):
        return doc, source, (place & 0xFFFFFFFFFF).astype(np.int32), at.astype(np.int32), (place >> 40).astype(np.int8)

    done = rows["source_c"] >= 0
    if done.any():
        some = rows[done]
        yield told(some["doc_id"], some["place"], some["source_doc"], some["source_c"])
    cols = [rows[name][~done] for name in _WINDOW.names[:5]]
    del rows
    head = _first_of(cols[0])
    some = np.bincount(head, minlength=len(head))[head] > 1
    cols = [c[some] for c in cols]
    order = np.lexsort((cols[2], cols[1]))  # by doc_id and centre
    key, doc, place, before, after = (x[order] for x in cols)
    n = len(key)
    if not n:
        return

    def linked(at: np.ndarray, head: np.ndarray):
        other = doc[at] != doc[head]
        at, head = at[other], head[other]
        return told(doc[at], place[at], doc[head], place[head] & 0xFFFFFFFFFF)

    # copies go to the first of them, which stands for them in all that follows
    head = _first_of(_hashed(key, before, after))
    copy = doc[head] != doc
    yield linked(np.flatnonzero(copy), head[copy])
    left = np.flatnonzero(~copy)
    for one, by_before in _narrowed(before[left], key[left]):
        found = []
        for two, first in _narrowed(after[left[one]], by_before):
            x, y = one[two], one[two[first]]
            found.append((x * len(left) + y)[doc[left[x]] != doc[left[y]]])
        found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        yield linked(left[found // len(left)], left[found % len(left)])


def _interval_batches(batches):
    """Links of a partition, which has all of a document, joined along their diagonals to intervals of some 200 words."""
    rows = _opened(_LINK, batches)
    if not len(rows):
        return
    doc, c, source, sc, fn = (rows[name].astype(np.int64) for name in ("doc_id", "c", "source_doc", "source_c", "fn"))
    del rows
    order = np.lexsort((c, c - sc, source, doc))
    doc, c, source, sc, fn = (x[order] for x in (doc, c, source, sc, fn))
    near = lambda x, most: np.abs(np.diff(x)) <= most
    # first by document, source and diagonal, then by place
    group = np.cumsum(np.append(True, ~((doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & near(c - sc, SLACK))))
    first = np.append(True, group[1:] != group[:-1])
    group = group * 4096 + ((c - sc) - (c - sc)[np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))]) // (3 * SLACK)
    order = np.lexsort((c, group))
    doc, c, source, sc, fn, group = (x[order] for x in (doc, c, source, sc, fn, group))
    new = np.append(True, (group[1:] != group[:-1]) | (np.diff(c) > 100))
    start = c[np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))]
    step = (c - start) // 200
    new |= np.append(True, step[1:] != step[:-1])
    at = np.flatnonzero(new)
    least, most = np.minimum.reduceat, np.maximum.reduceat
    a0, a1 = np.maximum(c[at] - MARGIN, 0), most(c, at) + SHINGLE + MARGIN
    b0, b1 = np.maximum(least(sc, at) - MARGIN - SLACK, 0), most(sc, at) + SHINGLE + MARGIN + SLACK
    names = ["doc_id", "chunk", "a0", "a1", "source_doc", "source_chunk", "b0", "b1", "d0", "d1", "fns"]
    cols = (doc[at], a0 // STEP, a0, a1, source[at], b0 // STEP, b0, b1, least(c - sc, at) - SLACK, most(c - sc, at) + SLACK, np.bitwise_or.reduceat(1 << fn, at))
    for k in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in cols], names)


_INTERVAL = "doc_id long, chunk long, a0 long, a1 long, source_doc long, source_chunk long, b0 long, b1 long, d0 long, d1 long, fns long"


def _chunk_batches(batches):
    """Chunks of ``CHUNK`` words, ``STEP`` apart, as hashes of 16 bits."""
    for batch in batches:
        for part in slices(batch, "words", 2 << 20):
            h, rows = hashed_words(part.column(1))
            h = (h >> np.uint64(20)).astype("<u2")
            size = np.diff(rows)
            count = -(-size // STEP)
            row = np.repeat(np.arange(len(size)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = rows[row] + nth * STEP
            end = np.minimum(begin + CHUNK, rows[row + 1])
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(nth), pa.array([raw[2 * a : 2 * b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())], ["doc_id", "chunk", "words"])


def _verify_batches(batches):
    """The passages of intervals with the words of both chunks."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            few = batch.slice(k, 2000)
            doc, chunk, a0, a1, source, other, b0, b1, d0, d1, fns = (few.column(x).to_numpy() for x in range(11))
            one, at = _cut(few.column(11), a0 - chunk * STEP, a1 - chunk * STEP)
            two, bt = _cut(few.column(12), b0 - other * STEP, b1 - other * STEP)
            row = np.repeat(np.arange(len(doc)), np.diff(at))
            if not len(one) or not len(two):
                continue
            place = np.arange(len(one)) - at[row] + a0[row]  # word of the document
            same_row = np.append(row[1:] == row[:-1], False)
            agree = np.zeros(len(one), bool)
            for t in range(int((d1 - d0).max()) + 1):
                some = np.flatnonzero((d1 - d0)[row] >= t)
                j = place[some] - d0[row[some]] - t - b0[row[some]] + bt[row[some]]
                ok = (j >= bt[row[some]]) & (j < bt[row[some] + 1])
                eq = np.zeros(len(one), bool)
                eq[some[ok]] = one[some[ok]] == two[j[ok]]
                next_ = np.append(eq[1:], False) & same_row
                three = eq & next_ & np.append((next_)[1:], False)
                agree |= three
                agree[1:] |= three[:-1]
                agree[2:] |= three[:-2]
            hit = np.flatnonzero(agree)
            if not len(hit):
                continue
            new = np.append(True, (row[hit][1:] != row[hit][:-1]) | (np.diff(hit) > GAP + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1
            start, end, r = place[hit[first]], place[hit[last]] + 1, row[hit[first]]
            good = (end - start >= SPAN // 2) & (last - first + 1 >= SIMILAR * (end - start))
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (doc[r], start, end, source[r], fns[r], last - first + 1)], ["doc_id", "start", "end", "source_doc", "fns", "same"])


def _cut(column: pa.Array, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words [begin, end) of each chunk on end, and where each row's begin."""
    raw = [np.frombuffer(x.as_buffer(), "<u2")[a:b] for x, a, b in zip(column, begin.tolist(), end.tolist())]
    return np.concatenate(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def repeats(docs: DataFrame, least: int = LEAST, hashes: int = HASHES, min_hashes: int = MIN_HASHES) -> DataFrame:
    """(doc_id, start, end, source_doc, functions): words [start, end) of doc_id are nearly a passage of source_doc, a smaller doc_id."""
    # one shuffle by minimum
    links = arrow_map(windows(docs, least, hashes).repartition("part"), _link_batches, _PARCEL)
    intervals = stored(arrow_map(links.repartition("part"), _interval_batches, _INTERVAL), "intervals")
    wanted = intervals.select("doc_id", "chunk").unionByName(intervals.select(F.col("source_doc").alias("doc_id"), F.col("source_chunk").alias("chunk")))
    chunks = stored(maybe_in(arrow_map(_words(docs), _chunk_batches, "doc_id long, chunk long, words binary"), wanted, ["doc_id", "chunk"]), "chunks")
    there = chunks.select(F.col("doc_id").alias("source_doc"), F.col("chunk").alias("source_chunk"), F.col("words").alias("source_words"))
    both = intervals.join(chunks, ["doc_id", "chunk"]).join(there, ["source_doc", "source_chunk"])
    both = both.select(*intervals.columns, "words", "source_words")
    found = stored(arrow_map(both, _verify_batches, "doc_id long, start long, end long, source_doc long, fns long, same long"), "passages")
    order = Window.partitionBy("doc_id", "source_doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = found.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + GAP), 1).otherwise(0)).withColumn("g", F.sum("new").over(order))
    spans = run.groupBy("doc_id", "source_doc", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.expr("CAST(bit_count(bit_or(fns)) AS INT)").alias("functions"))
    return spans.where((F.col("functions") >= min_hashes) & (F.col("end") - F.col("start") >= SPAN)).select("doc_id", "start", "end", "source_doc", "functions")
