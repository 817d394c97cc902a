"""Vectorised word splitting and hashing over Arrow string columns.

Texts stay UTF-8 bytes in one buffer; words are runs of "word bytes".  Both word rules used here are
byte rules (every byte of a non-ASCII character is a word byte), so no text is decoded.  Memory is
bounded by ``PIECE`` bytes plus the longest single text, whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in pieces of about this many bytes.
PIECE = 1 << 21

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(64, np.uint64)


def _byte_set(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes outside ``ranges``."""
    t = np.ones(256, bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = False
    return t


#: Words of letters, digits and non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = _byte_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
ALNUM[65:91] = True
#: Words between white space: [^\x20\x09-\x0D]+
SPACED = _byte_set([(0x20, 0x20), (0x09, 0x0D)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seed_powers() -> np.ndarray:
    out = np.empty(4096, np.uint64)
    x = 1
    for i in range(4096):
        out[i] = x
        x = x * int(_BASE) % 2**64
    return out


def _grow(n: int) -> np.ndarray:
    """Powers of the base, at least n of them."""
    global _POW
    if len(_POW) < 4096:
        _POW = _seed_powers()
    while len(_POW) < n:
        step = np.uint64(int(_POW[-1]) * int(_BASE) % 2**64)
        _POW = np.concatenate([_POW, _POW * step])
    return _POW


@dataclass
class Words:
    """Words of rows lo..hi-1 of a batch: ``hash`` per word, words of row i are first[i]:first[i+1]."""

    lo: int
    hi: int
    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray  # byte offsets of words in buf
    length: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray  # byte offsets of rows lo..hi in buf


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    n = len(arr)
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    if arr.null_count and (np.diff(off)[~np.asarray(arr.is_valid())] > 0).any():
        arr = pa.array([x or "" for x in arr.to_pylist()], arr.type)
        return text_buffer(arr)
    return data, off


def words(arr: pa.Array, word: np.ndarray, hashes: bool = True) -> Iterator[Words]:
    """Split each text of ``arr`` into words, piece by piece, in row order."""
    data, off = text_buffer(arr)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, "right")) - 1)
        hi = min(hi, n)
        base = off[lo]
        buf, rows = data[base : off[hi]], off[lo : hi + 1] - base
        yield _split(buf, rows, word, lo, hi, hashes)
        lo = hi


def _split(buf: np.ndarray, rows: np.ndarray, word: np.ndarray, lo: int, hi: int, hashes: bool) -> Words:
    m = len(buf)
    if m == 0:
        z = np.zeros(0, np.int64)
        return Words(lo, hi, np.zeros(hi - lo + 1, np.int64), np.zeros(0, np.uint64), z, z, buf, rows)
    is_word = word[buf]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    edge = rows[:-1][rows[:-1] < m]
    begin[edge] = is_word[edge]
    start = np.flatnonzero(begin)
    stop = is_word.copy()  # last byte of a word
    stop[:-1] &= ~is_word[1:]
    last = rows[1:] - 1
    last = last[(last >= 0)]
    stop[last] = is_word[last]
    end = np.flatnonzero(stop) + 1
    length = end - start
    first = np.searchsorted(start, rows)
    h = np.zeros(0, np.uint64)
    if hashes and len(start):
        at = np.flatnonzero(is_word)
        first_byte = np.cumsum(length) - length
        within = np.arange(len(at)) - np.repeat(first_byte, length)
        power = _grow(int(length.max()) + 1)
        h = mix(np.add.reduceat(_BYTE[buf[at]] * power[within], first_byte) + length.astype(np.uint64))
    return Words(lo, hi, first, h, start, length, buf, rows)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every n consecutive words (len(h) - n + 1 values)."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + k]
    return mix(out)


def hash_word(text: str) -> int:
    """Hash of one word, equal to what ``words`` gives."""
    w = next(words(pa.array([text]), np.ones(256, bool)))
    return int(w.hash[0])


def word_lists(arr: pa.Array, word: np.ndarray) -> list[list[bytes]]:
    """Lower-cased words as bytes, for small tables (templates, benchmark items)."""
    out: list[list[bytes]] = []
    for w in words(arr, word, hashes=False):
        raw = w.buf.tobytes()
        for i in range(w.hi - w.lo):
            a, b = w.first[i], w.first[i + 1]
            out.append([raw[s : s + k].lower() for s, k in zip(w.start[a:b], w.length[a:b])])
    return out
