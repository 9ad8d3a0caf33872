"""Vectorized word kernels over UTF-8 buffers.

Words are found and hashed for a whole block of documents at once: a byte mask
gives the spans and a polynomial prefix sum modulo 2**64 gives every span's hash.
N-gram hashes are composed by doubling from the hashes of shorter grams.

A block never splits a document, but what takes eight bytes or more for each
byte of text is made in pieces of PIECE_BYTES. A very long text so needs a few
times its own size (the spans and hashes of its words) and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT, _GRAM = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93)
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BLOCK_BYTES = 1 << 19
PIECE_BYTES = 1 << 19

#: The bytes that separate words, space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
#: Bytes of alphanumeric words; every byte of a non-ASCII character counts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTE_LOWER = _BYTE[LOWER]


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_byte_powers = _Powers(_MULT)


def _pieces(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + PIECE_BYTES)) for a in range(0, n, PIECE_BYTES))


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes of each span (sorted, apart), from the prefix sums of one piece at a time."""
    out = np.zeros(len(starts), U)
    for a, b in _pieces(len(data)):
        up, down = _byte_powers.to(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(byte[data[a:b]] * up[: b - a], out=sums[1:])
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if lo < hi:
            s, e = np.maximum(starts[lo:hi], a) - a, np.minimum(ends[lo:hi], b) - a
            part = (sums[e] - sums[s]) * down[s]
            if starts[lo] < a:  # goes on from an earlier piece
                part[:1] *= U(pow(int(_MULT), int(a - starts[lo]), 1 << 64))
            out[lo:hi] += part
    return mix(out + (ends - starts).astype(U))


def class_counts(kind: np.ndarray, data: np.ndarray, bounds: np.ndarray, classes: int) -> np.ndarray:
    """How many bytes of each class (``kind`` of 256) lie between consecutive bounds."""
    out = np.zeros((len(bounds) - 1) * classes, np.int64)
    for a, b in _pieces(len(data)):
        lo, hi = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
        at = np.repeat(np.arange(hi - lo), np.diff(np.clip(bounds[lo : hi + 1], a, b)))
        out[lo * classes : hi * classes] += np.bincount(at * classes + kind[data[a:b]], minlength=(hi - lo) * classes)
    return out.reshape(-1, classes)


class Block:
    """Words of consecutive documents: spans, hashes and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD, lower: bool = False):
        self.data, self.offsets = data, offsets
        mask = np.zeros(len(data) + 2, bool)
        mask[1:-1] = kind[data]
        edge = mask[1:] != mask[:-1]
        inner = offsets[1:-1]
        both = inner[(inner > 0) & (inner < len(data))]
        both = np.unique(both[mask[both] & mask[both + 1]])
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]))
        self.starts, self.ends = at[0::2], at[1::2]
        self.first = np.searchsorted(self.starts, offsets)
        self.lower = lower
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _span_hashes(self.data, self.starts, self.ends, _BYTE_LOWER if self.lower else _BYTE)
        return self._hashes

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; positions near a document's end mix two documents."""
        return gram_hashes(self.hashes, k)

    def lowered(self) -> Block:
        """The same words, hashed in lower case."""
        out = Block.__new__(Block)
        out.__dict__ |= self.__dict__ | {"lower": True, "_hashes": None}
        return out

    def bytes_of(self, a: int, b: int) -> bytes:
        return self.data[a:b].tobytes()


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words: the polynomial of their hashes, composed from runs of 1, 2, 4, ... words."""
    n, want = len(hashes) - k + 1, k
    if n < 1:
        return np.zeros(0, U)
    power = lambda m: U(pow(int(_GRAM), m, 1 << 64))
    run, width, out, have = hashes, 1, None, 0
    while want:
        if want & 1:
            out = run if out is None else out[: len(run) - have] + power(have) * run[have : have + len(out)]
            have += width
        want >>= 1
        if want:
            run = run[:-width] + power(width) * run[width:]
            width *= 2
    return mix(out[:n] + U(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if have < w else out


def blocks(batch: pa.RecordBatch, kind: np.ndarray = WORD, lower: bool = False, text: str = "text") -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, Block) of a batch; a null text is an empty one.

    A block ends at BLOCK_BYTES, but never within a document.
    """
    column = batch.column(batch.schema.get_field_index(text))
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], kind, lower)
        at = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
