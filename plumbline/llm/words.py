"""Words of whole Arrow columns, found and hashed with numpy, without a Python object per word.

A word is a longest run of bytes that are no separators. UTF-8 bytes of non-ASCII characters are never separators here, so byte
classes and code point classes agree. A-Z count as a-z. Words are told apart by 64-bit hashes (two given different words share
one with a chance of about 2**-64).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def _give_back() -> None:
    """Has large blocks of memory mapped by themselves, so that they go back to the system when freed, whatever lies around them."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        c = ctypes.CDLL(None)
        c.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


_give_back()
#: Text handled at once, in bytes; a longer text is handled alone.
PIECE = 1 << 17

_SPACE = [0x20, *range(0x09, 0x0E)]
#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = np.isin(np.arange(256), _SPACE)
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
NOT_ALNUM = np.array([not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80) for c in range(256)])
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))[LOWER]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, base, U)]), dtype=U)
    return _powers[0], _powers[1]


class Words:
    """Words of consecutive texts. start, end: in buf; first[i]:first[i + 1]: the words of text i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.buf, self.offsets = buf, offsets
        sep = separators[buf]
        edge = np.ones(len(buf) + 1, bool)  # whether a word cannot go on across this place
        edge[1:] = False
        edge[offsets] = True
        word = ~sep
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= sep[:-1]
        after[:-1] |= sep[1:]
        if len(buf):
            after[-1] = True
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        power, inverse = _up_to(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, U)
        np.cumsum(_BYTE[self.buf] * power[: len(self.buf)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))

    def of_text(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, lo: int, hi: int) -> bytes:
        """Lower-cased words lo to hi, joined by one space."""
        return b" ".join(LOWER[self.buf[self.start[i] : self.end[i]]].tobytes() for i in range(lo, hi))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of consecutive texts of up to limit bytes together, or of one longer text; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(texts: pa.Array, separators: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, buf, offsets in pieces(texts, limit):
        yield lo, hi, Words(buf, offsets, separators)


_ODD = mix(np.arange(1, 65, dtype=U)) | U(1)
