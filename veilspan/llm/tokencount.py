"""Edit-aware token counts.

``counted`` gives each document's tree, which is stored: its leaves are the pieces (see
``tokens``), each with its characters and tokens; the sums of the inner nodes follow
from them. ``edited`` takes stored trees, the documents and a table of edits. An edit is
found by descending through the characters; the pieces that it touches and the one
before (it may now join the new text) are put together, encoded anew and stored as one
leaf; the sums on the way up are set again. All other pieces keep their counts, and
documents without an edit are neither moved nor encoded.

Edits are (doc_id, key, seq, start, end, replacement): characters [start, end) of the
text that the edits of a smaller seq have left are replaced. The key is that of the text
they were made for, so edits of an outdated text do nothing. ``redactions`` makes such a
table: identifiers are replaced by a tag, from the last to the first.

Defined results
* null text: counts are null, no edit; empty text: 0;
* null doc_id: the row is counted; no edit can name it;
* very long texts: an edit costs its own pieces and the tree's height;
* ties: edits of one seq are applied by start, end and replacement; an edit outside the
  text is an error;
* repeated rows: each row is counted, and edited alike; rows that share a doc_id but not
  the text have edits of their own;
* empty tables give empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, key_of, maybe_in, stored
from .kernel import bytes_of, slices
from .tokens import TOKENIZERS, VOCABULARY, Tokenizer, pieces_of, tokenizer

_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True
_EDITS = re.compile(
    r"(?P<EMAIL>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|(?P<PHONE>\+\d{1,2} \(\d{3}\) \d{3}-\d{4})"
    r"|(?P<IP>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]))|(?P<CARD>(?<!\d)\d{16}(?!\d))|(?P<SECRET>(?<![0-9a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?![0-9a-f]))"
)
EDITS = "doc_id long, key long, seq int, start int, end int, replacement string"


def redaction_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of each identifier, last first."""
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in _EDITS.finditer(text)][::-1]


def packed(values: np.ndarray) -> bytes:
    """Small integers, each in as many bytes as the largest needs; the first byte says how many."""
    size = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class CountTree:
    """Characters and tokens of a text, by pieces; ``chars`` and ``counts`` are those of its leaves, where they are known."""

    def __init__(self, text: str, tok: Tokenizer, chars: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.tok, self._text = tok, text
        if chars is None:
            pieces = pieces_of(text)
            chars = np.array([len(p) for p in pieces], np.int64)
            counts = np.array([len(tok.enc.encode_ordinary(p)) for p in pieces], np.int64)
        n = self.width = 1 << max(0, (max(1, len(chars)) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        self.chars[n : n + len(chars)] = chars
        self.tokens[n : n + len(chars)] = counts
        while n > 1:
            n //= 2
            for a in (self.chars, self.tokens):
                a[n : 2 * n] = a[2 * n : 4 * n].reshape(-1, 2).sum(1)
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves that have any."""
        chars, tokens = self.chars[self.width :], self.tokens[self.width :]
        return chars[chars > 0], tokens[chars > 0]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that has character ``at``, and its first character's place."""
        node, base = 1, 0
        while node < self.width:
            node *= 2
            if at - base >= self.chars[node]:
                base += int(self.chars[node])
                node += 1
        return node - self.width, base

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        self.chars[node], self.tokens[node] = chars, tokens
        node //= 2
        while node:
            for a in (self.chars, self.tokens):
                a[node] = a[2 * node] + a[2 * node + 1]
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by ``new``."""
        size = int(self.chars[1])
        if not 0 <= start <= end <= size:
            raise IndexError("edit outside the text")
        first, base = self._find(max(start - 1, 0)) if size else (0, 0)
        last, last_base = self._find(min(end, size - 1)) if size else (0, 0)
        stop = last_base + int(self.chars[last + self.width]) if size else 0
        region = self._text[base:start] + new + self._text[end:stop]
        pieces = pieces_of(region)
        self.encoded += len(pieces)
        self._text = self._text[:start] + new + self._text[end:]
        self._set(first, len(region), sum(len(self.tok.enc.encode_ordinary(p)) for p in pieces))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, 0, 0)

    def text(self) -> str:
        return self._text


def _few(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNotNull(), key_of(text)).alias("key"), text.alias("text"))


def _count(folder: str, vocabulary: str):
    def run(batches):
        tok = tokenizer(folder, vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                column = part.column(2)
                data, at = bytes_of(column)
                begins, rows, _, count = tok.pieces(column)
                # a byte begins a character unless it continues one
                upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
                chars = np.diff(upto[np.append(begins, len(data))])
                total = np.diff(np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[rows])
                null = column.is_null().to_numpy(zero_copy_only=False)
                trees = [[packed(x[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())] for x in (chars, count)]
                arrays = [part.column(0), part.column(1), pa.array(total, pa.int64(), mask=null), pa.array(np.diff(rows), pa.int64()), *(pa.array(x, pa.binary()) for x in trees)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "tokens", "pieces", "chars", "counts"])

    return run


def counted(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, key, tokens, pieces, chars, counts): a tree for each row of ``docs``; the last two are its leaves (see ``unpacked``)."""
    return arrow_map(_few(docs), _count(folder, vocabulary), "doc_id long, key long, tokens long, pieces long, chars binary, counts binary")


def _edit_batches(batches):
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            data, at = bytes_of(part.column(2))
            # only texts with a digit or an @ can have an identifier
            marks = np.concatenate([[0], np.cumsum(_MARK[data], dtype=np.int32)])
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for k in np.flatnonzero(marks[at[1:]] > marks[at[:-1]]).tolist():
                for seq, e in enumerate(redaction_edits(data[at[k] : at[k + 1]].tobytes().decode())):
                    for col, x in zip(out, (part.column(0)[k].as_py(), part.column(1)[k].as_py(), seq, *e)):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "key", "seq", "start", "end", "replacement"])


def redactions(docs: DataFrame) -> DataFrame:
    """The edits that replace the identifiers of each text by tags."""
    return arrow_map(_few(docs).where("doc_id IS NOT NULL AND text IS NOT NULL"), _edit_batches, EDITS)


def _apply(folder: str, vocabulary: str):
    def run(batches):
        tok = tokenizer(folder, vocabulary)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for k in range(batch.num_rows):
                doc_id, key, text, chars, counts, edits = (batch.column(c)[k].as_py() for c in range(6))
                tree = CountTree(text, tok, unpacked(chars), unpacked(counts))
                for e in edits:
                    tree.edit(e["start"], e["end"], e["replacement"])
                new = tree.leaves()
                for col, x in zip(out, (doc_id, key, tree.total, len(edits), tree.encoded, *map(packed, new), tree.text())):
                    col.append(x)
            kinds = (*(pa.int64(),) * 5, pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "key", "tokens", "edits", "pieces_encoded", "chars", "counts", "text"])

    return run


def edited(docs: DataFrame, trees: DataFrame, edits: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, key, tokens, edits, pieces_encoded, chars, counts, text) of each text that ``edits`` changes, once: its new tree and text; the key is still the old text's."""
    edits = stored(edits, "edits")
    lists = edits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    one = maybe_in(trees, edits, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.any_value("chars").alias("chars"), F.any_value("counts").alias("counts"))
    touched = maybe_in(_few(docs), edits, ["doc_id", "key"]).join(lists, ["doc_id", "key"]).join(one, ["doc_id", "key"]).select("doc_id", "key", "text", "chars", "counts", "edits").dropDuplicates(["doc_id", "key"])
    return arrow_map(touched, _apply(folder, vocabulary), "doc_id long, key long, tokens long, edits long, pieces_encoded long, chars binary, counts binary, text string")


def recounted(docs: DataFrame, edits: DataFrame | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens_before, tokens_after, edits, pieces, pieces_encoded) of every document, before and after ``edits`` (its redactions, if none are given)."""
    trees = stored(counted(docs, folder, vocabulary), "count-trees")
    edits = redactions(docs) if edits is None else edits
    new = edited(docs, trees, edits, folder, vocabulary).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("tokens").alias("after"), "edits", "pieces_encoded")
    out = trees.select("doc_id", "key", "tokens", "pieces").join(new, (F.col("doc_id") == F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", F.col("tokens").alias("tokens_before"), F.coalesce("after", "tokens").alias("tokens_after"), F.coalesce("edits", none).alias("edits"), "pieces", F.coalesce("pieces_encoded", none).alias("pieces_encoded"))
