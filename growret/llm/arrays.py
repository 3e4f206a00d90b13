"""Word arrays over Arrow string batches, shared by the training-data operators.

A batch of texts is handled as one byte buffer: word bounds, word hashes and
window hashes are numpy expressions over the whole buffer, never a Python loop
per word.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, the
same words as the pattern ``[^\\x20\\x09-\\x0D]+`` on the text (UTF-8 never
uses those bytes inside a longer character).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the byte and word polynomials (any odd numbers do).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte but letters and digits, for words without their punctuation.
_PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_BYTE = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLD = _BYTE.copy()
_FOLD[0x41:0x5B] = _BYTE[0x61:0x7B]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept per process."""
    size = 1 << max(12, (n - 1).bit_length())
    if (base, size) not in _POWERS:
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        np.cumprod(p, out=p)
        _POWERS[base, size] = p
    return _POWERS[base, size][:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def slices(texts: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each (one longer text goes alone)."""
    n = len(texts)
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
        yield lo, min(hi, n)
        lo = hi


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its rows; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time through ``mix``.

    A chain of bijections, not a polynomial: ranges that differ by a pattern
    (Thue-Morse words, for which every polynomial modulo 2**64 is equal) part
    at the first eight bytes that differ and meet again by chance only.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = (end - start).astype(U64)
    out = mix(length ^ U64(WORD_BASE))
    rest, done = np.flatnonzero(length), 0
    while len(rest):
        left = length[rest] - U64(done)
        part = eight[start[rest] + done].astype(U64)
        spare = (U64(8) - np.minimum(left, U64(8))) << U64(3)  # bits that belong to the next word
        part = (part << spare) >> spare
        out[rest] = mix((out[rest] ^ part) * U64(BYTE_BASE) + U64(WORD_BASE))
        rest, done = rest[left > U64(8)], done + 8
    return out


class Words:
    """Words of a batch: byte ``start``/``end``, 64-bit ``hash``, and ``off``, where rows' words begin."""

    def __init__(self, texts: pa.Array, fold_case: bool = False, punctuation: bool = True) -> None:
        data, rows = byte_buffer(texts)
        self.data, self.rows = data, rows
        n = len(data)
        word = ~(_SPACE if punctuation else _PUNCTUATION)[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[rows] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.off = np.searchsorted(self.start, rows)
        self._values = _FOLD if fold_case else _BYTE
        self._total = None
        self.hash = word_hashes(_LOWER[data] if fold_case else data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges from one running polynomial: for features, not where equality must be sure."""
        if self._total is None:
            n = len(self.data)
            self._total = np.zeros(n + 1, dtype=U64)
            np.cumsum(self._values[self.data] * _powers(BYTE_BASE, n), out=self._total[1:])
        back = _powers(_inverse(BYTE_BASE), len(self.data) + 1)
        return mix((self._total[end] - self._total[start]) * back[start])

    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``width``-word windows that lie inside one row, and their first words."""
        n = len(self)
        if n < width:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        last = np.repeat(self.off[1:], self.count())  # end of the word's row
        first = np.flatnonzero(np.arange(n) + width <= last)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.hash * _powers(WORD_BASE, n), out=total[1:])
        return mix((total[first + width] - total[first]) * _powers(_inverse(WORD_BASE), n + 1)[first]), first


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as one width byte, the first value, and differences of that width."""
    if not len(values):
        return b"\x01"
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    little = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + values[:1].astype("<u8").tobytes() + np.ascontiguousarray(little).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if len(blob) < 9:
        return np.zeros(0, U64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(raw) + 1, 8), np.uint8)
    gaps[1:, :width] = raw
    out = gaps.reshape(-1).view("<u8").astype(U64)
    out[0] = np.frombuffer(blob, "<u8", count=1, offset=1)[0]
    return np.cumsum(out, dtype=U64)
