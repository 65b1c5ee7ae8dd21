"""Token ids as one wavelet matrix file a shard.

A shard is a run of documents of about ``SHARD_BYTES`` of text, or one longer
document. Its tokens become a bit plane a bit of the id. The file has the documents'
ids and bounds, counts of ones by blocks of ``BLOCK`` bits, and the planes in chunks of
``CHUNK`` bits, each a zstd frame of its own with its place in a directory. So a token
is read, an id counted up to a position and its k-th occurrence found from the file
alone, by unpacking only the chunks that are asked: at most one a plane for an access.

Defined results
* null and empty texts have no token; they keep their place with a length of 0;
* null doc_id: the row is stored, its id reads as None;
* very long documents are whole in one shard;
* ties and repeated rows: each row is stored, in the order of the input;
* empty tables give no shard; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import mmap
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .kernel import bytes_of, slices
from .tokens import TOKENIZERS, VOCABULARY, tokenizer

SHARD_BYTES = 8 << 20
#: Bits to a count of ones, and bits to a zstd frame.
BLOCK, CHUNK = 512, 1 << 19
_MAGIC, _HEAD = b"VWM2", struct.Struct("<4sIQQQ")


def build(tokens: np.ndarray, ids: pa.Array | None = None, begins: np.ndarray | None = None) -> bytes:
    """The file of a sequence of ids, and of the documents that they are of."""
    n, ids = len(tokens), pa.array([], pa.int64()) if ids is None else ids
    begins = np.zeros(1, np.int64) if begins is None else begins
    seq = tokens.astype(np.uint32)
    levels = max(1, int(seq.max()).bit_length() if n else 1)
    if levels <= 16:
        seq = seq.astype(np.uint16)
    zeros, befores, frames = [], [], []
    pack = zstandard.ZstdCompressor(level=1)
    for level in range(levels - 1, -1, -1):
        bit = ((seq >> seq.dtype.type(level)) & seq.dtype.type(1)).astype(bool)
        bits = np.packbits(bit, bitorder="little")
        blocks = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        blocks[: len(bits)] = bits
        ones = np.bitwise_count(blocks.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        before = np.zeros(len(ones) + 1, np.uint32)
        np.cumsum(ones, out=before[1:])
        zeros.append(n - int(before[-1]))
        befores.append(before.tobytes())
        frames += [pack.compress(blocks[k : k + CHUNK // 8].tobytes()) for k in range(0, len(blocks), CHUNK // 8)]
        if level:
            seq = np.concatenate([seq[~bit], seq[bit]])
    ends = np.cumsum([0, *map(len, frames)]).astype("<u8")
    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    counts = pack.compress(b"".join(befores))
    head = _HEAD.pack(_MAGIC, levels, n, len(ids), len(counts))
    return b"".join([head, np.array(zeros, "<u8").tobytes(), ends.tobytes(), begins.astype("<i8").tobytes(), numbers.tobytes(), null.tobytes(), counts, *frames])


class WaveletMatrix:
    """Reads what ``build`` made: bytes, or anything that gives bytes when sliced (a mapped file)."""

    def __init__(self, file):
        self._file, size = file, _HEAD.size
        magic, self.levels, self.n, docs, counts = _HEAD.unpack(file[:size])
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        blocks = -(-self.n // BLOCK)
        self._wide = -(-blocks * BLOCK // CHUNK)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal size
            at, size = size, size + n * np.dtype(kind).itemsize
            return np.frombuffer(file[at:size], kind)

        self.zeros = take("<u8", self.levels).astype(np.int64)
        self._ends = take("<u8", self.levels * self._wide + 1)
        self.begins = take("<i8", docs + 1)
        numbers = take("<i8", docs)
        self.doc_ids = [None if no else i for i, no in zip(numbers.tolist(), take("u1", docs).tolist())]
        self._before = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(file[size : size + counts])), "<u4").reshape(self.levels, blocks + 1)
        self._data = size + counts
        #: Chunks that have been unpacked.
        self.chunks: dict[int, np.ndarray] = {}

    def _chunk(self, plane: int, k: int) -> np.ndarray:
        k += plane * self._wide
        if k not in self.chunks:
            a, b = (self._data + int(e) for e in self._ends[k : k + 2])
            self.chunks[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self._file[a:b])), "<u8")
        return self.chunks[k]

    def _words(self, plane: int, word: np.ndarray) -> np.ndarray:
        """The 64-bit words at these places of a plane."""
        out, chunk = np.zeros(len(word), np.uint64), word // (CHUNK // 64)
        for k in np.unique(chunk).tolist():
            at = chunk == k
            have = self._chunk(plane, k) if k < self._wide else np.zeros(0, np.uint64)
            place = word[at] % (CHUNK // 64)
            inside = place < len(have)  # beyond the last word all is 0
            out[np.flatnonzero(at)[inside]] = have[place[inside]]
        return out

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        block, rest = at // BLOCK, at % BLOCK
        out = self._before[plane][block].astype(np.int64)
        for k in range(BLOCK // 64):
            inside = np.clip(rest - 64 * k, 0, 64)
            some = np.flatnonzero(inside)
            if not len(some):
                break
            shift = (64 - inside[some]).astype(np.uint64)
            out[some] += np.bitwise_count(self._words(plane, block[some] * (BLOCK // 64) + k) << shift).astype(np.int64)
        return out

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (self._words(k, at >> 6) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._rank1(k, at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            out = (out << 1) | bit
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of document k."""
        return self.access(np.arange(self.begins[k], self.begins[k + 1]))

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for k in range(self.levels):
            a, b = self._rank1(k, np.array([low, high]))
            if token >> (self.levels - 1 - k) & 1:
                low, high = int(self.zeros[k]) + int(a), int(self.zeros[k]) + int(b)
            else:
                low, high = low - int(a), high - int(b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` is among the first ``end`` ids."""
        if token >> self.levels:
            return 0
        low, high = self._range(token, min(end, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if token >> self.levels or not 0 <= k < self.count(token):
            raise IndexError("no such occurrence")
        at = self._range(token, self.n)[0] + k
        for p in range(self.levels - 1, -1, -1):
            zeros = int(self.zeros[p])
            one = token >> (self.levels - 1 - p) & 1
            at = self._select(p, at - zeros if one else at, bool(one))
        return at

    def _select(self, plane: int, k: int, one: bool) -> int:
        before = self._before[plane]
        total = before.astype(np.int64) if one else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(total, k, side="right")) - 1
        bits = np.unpackbits(self._words(plane, block * (BLOCK // 64) + np.arange(BLOCK // 64)).view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(total[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def _shards(folder: str, vocabulary: str):
    def run(batches):
        tok = tokenizer(folder, vocabulary)
        task = TaskContext.get().partitionId()
        ids, lengths, tokens, size, n = [], [], [], 0, 0

        def done():
            flat = np.concatenate(tokens)
            begins = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            doc_ids = pa.concat_arrays(ids)
            arrays = [pa.array([f"{task:06d}-{n:06d}"]), pa.array([len(doc_ids)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([build(flat, doc_ids, begins)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "n_docs", "n_tokens", "matrix"])

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got, length = tok.encode_all(part.column(1))
                ids.append(part.column(0))
                lengths.append(length)
                tokens.append(got.astype(np.uint16) if tok.size <= 65536 else got)
                size += int(bytes_of(part.column(1))[1][-1])
                if size >= SHARD_BYTES:
                    yield done()
                    ids, lengths, tokens, size, n = [], [], [], 0, n + 1
        if ids:
            yield done()

    return run


def sharded(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, n_docs, n_tokens, matrix): document k of a shard has the tokens [begins[k], begins[k+1]) of its matrix, a file that ``WaveletMatrix`` reads."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(few, _shards(folder, vocabulary), "shard string, n_docs long, n_tokens long, matrix binary")


def _saving(to: str):
    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(to)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):
                shard, docs, tokens, matrix = (batch.column(c)[k] for c in range(4))
                path = f"{base}/{shard.as_py()}.vwm"
                # a task that is run again, or twice at once, puts the same file in place
                with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
                    f.write(matrix.as_buffer())
                fs.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, docs.as_py(), tokens.as_py())], ["path", "n_docs", "n_tokens"])

    return run


def saved(docs: DataFrame, to: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(path, n_docs, n_tokens) of the shards' files, which tasks write into the folder ``to`` (a URI that all executors reach) when this is run."""
    return arrow_map(sharded(docs, folder, vocabulary), _saving(to), "path string, n_docs long, n_tokens long")


def opened(path: str) -> WaveletMatrix:
    """A file on a mounted disk, mapped: only what is asked is read."""
    with open(path, "rb") as f:
        return WaveletMatrix(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
