"""A public byte-level BPE vocabulary, applied piece by piece with a bounded table.

A text is cut only where no pre-token can span: before a space or a line feed that
follows a character that is not white space. What the encoder makes of the pieces,
put on end, is what it makes of the text. Pieces are found, hashed and looked up for
a whole column at once; those not in the table are encoded together.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

from .kernel import bytes_of, word_hashes

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where no two white space characters are adjacent, without look-around.
_PLAIN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
#: Pieces that a worker keeps the tokens of, and tokens that it keeps before it begins anew.
SLOTS, MOST_KEPT = 1 << 20, 1 << 24

_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


@lru_cache(4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces_of(text: str) -> list[str]:
    """Pieces that encode on their own; ``"".join`` of them is the text."""
    return _SAFE.split(text) if text else []


def _space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is (or may be) white space. Every position has three bytes before it."""
    a, b, c = data[at - 1], data[at - 2], data[at - 3]
    wide = ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE3) & (b == 0x80)) | ((c == 0xE1) & (b == 0x9A))
    return _ASCII_SPACE[a] | wide


class Tokenizer:
    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.enc = encoder(folder, vocabulary)
        self.plain = encoder(folder, vocabulary, _PLAIN)
        self.size = self.enc.max_token_value + 1
        self.token_bytes = np.zeros(self.size, np.int64)
        for token in range(self.size):
            try:
                self.token_bytes[token] = len(self.enc.decode_single_token_bytes(token))
            except KeyError:
                pass  # a free id
        self._new()

    def _new(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.place = np.zeros(SLOTS, np.int64)
        self.count = np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, tokens: np.ndarray) -> int:
        """Put tokens on end; returns where they begin."""
        at = self.used
        if at + len(tokens) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(tokens)), np.uint32)])
        self.flat[at : at + len(tokens)] = tokens
        self.used += len(tokens)
        return at

    def _encode(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces that are not known: where their tokens begin in ``flat``, and how many they are."""
        place, count = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int32)
        ends = begins + lengths
        first = raw[begins]
        # pieces that begin at a cut, hold no other white space and do not end in any can be encoded on end
        inner = np.concatenate([[0], np.cumsum(_ASCII_SPACE[raw])])
        high = np.concatenate([[0], np.cumsum(np.isin(raw, (0xC2, 0xE1, 0xE2, 0xE3)))])
        joined = ((first == 32) | (first == 10)) & (inner[ends] - inner[begins] == 1) & (high[ends] == high[begins]) & (lengths > 1)
        many = np.flatnonzero(joined)
        if len(many):
            size = lengths[many]
            shift = np.repeat(begins[many] - (np.cumsum(size) - size), size)
            text = raw[np.arange(int(size.sum())) + shift].tobytes().decode()
            tokens = np.array(self.plain.encode_ordinary(text), np.uint32)
            edge = np.concatenate([[0], np.searchsorted(np.cumsum(self.token_bytes[tokens]), np.cumsum(size)) + 1])
            place[many] = self._keep(tokens) + edge[:-1]
            count[many] = np.diff(edge)
        for k in np.flatnonzero(~joined).tolist():
            tokens = self.enc.encode_ordinary(raw[begins[k] : ends[k]].tobytes().decode())
            place[k], count[k] = self._keep(np.array(tokens, np.uint32)), len(tokens)
        return place, count

    def pieces(self, column: pa.Array):
        """(begins, rows, place, count): byte where each piece begins, index of each row's first piece (one more
        entry than rows), and the piece's tokens ``flat[place : place + count]``, good until the next call."""
        if self.used > MOST_KEPT:
            self._new()
        data, at = bytes_of(column)
        raw = np.concatenate([np.zeros(3, np.uint8), data])
        break_ = np.flatnonzero((data == 32) | (data == 10))
        cut = np.zeros(len(data) + 1, bool)
        cut[break_[~_space_before(raw, break_ + 3)]] = True
        cut[at[:-1][at[:-1] < at[1:]]] = True
        begins = np.flatnonzero(cut[: len(data)])
        lengths = np.diff(np.append(begins, len(data)))
        h = word_hashes(data, begins, lengths)
        h[h == 0] = 1
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        place, count = self.place[slot], self.count[slot]
        lost = np.flatnonzero(self.keys[slot] != h)
        if len(lost):
            key, head, back = np.unique(h[lost], return_index=True, return_inverse=True)
            which = lost[head]
            p, c = self._encode(data, begins[which], lengths[which])
            place[lost], count[lost] = p[back], c[back]
            to = slot[which]
            self.keys[to], self.place[to], self.count[to] = key, p, c
        return begins, np.searchsorted(begins, at), place, count

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts on end, and how many each text has. Null has none."""
        _, rows, place, count = self.pieces(column)
        end = np.cumsum(count, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        tokens = self.flat[np.repeat(place - (end - count), count) + np.arange(total)]
        upto = np.concatenate([[0], end])
        return tokens, np.diff(upto[rows])


@lru_cache(2)
def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Tokenizer:
    """One a worker process, so that its cache serves all its tasks."""
    return Tokenizer(folder, vocabulary)
