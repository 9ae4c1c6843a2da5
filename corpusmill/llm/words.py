"""Vectorised word and shingle hashing over Arrow string columns.

A word is a longest run of ``a-z0-9`` of the lower-cased text (the caller
lower-cases on the JVM side, so Unicode case rules are Java's).  Every function
takes whole columns: one pass over the bytes with numpy, no per-word Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = True
_WORD[97:123] = True
#: Bits of a shingle token; the rest of a 64-bit sort key names the row.
TOKEN_BITS = 44
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits over all output bits (wraps mod 2**64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row (length rows + 1)."""
    w = _WORD[raw]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = w[:-1]
    cuts = offs[:-1]
    prev[cuts[cuts < n]] = False
    start = w & ~prev
    follow = np.empty(n, bool)
    follow[-1] = False
    follow[:-1] = w[1:]
    ends = offs[1:] - 1
    follow[ends[ends >= 0]] = False
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(w & ~follow) + 1, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over its bytes, finalised."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(raw))
    acc = np.empty(len(raw) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words within a row, and each one's row number."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = rows[: m] == rows[n - 1 :]
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _BASE + words[k : k + m]
    return mix(h[keep]), rows[:m][keep]


def blocks(offs: np.ndarray, limit: int = 1 << 22, rows: int = 1 << 18):
    """Row ranges of at most ``limit`` bytes (a longer row stands alone) and ``rows`` rows."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), a + rows, n)
        yield a, b
        a = b


def distinct_shingles(col: pa.Array, n: int, min_words: int, salt: int = 0):
    """Yields (row range, words per row, tokens per row, tokens) of row blocks.

    Tokens are the distinct n-word shingles of a row as sorted 44-bit hashes, in row
    order; a row of fewer than ``min_words`` words has none.
    """
    raw_all, offs_all = column_bytes(col)
    shift = _U(64 - TOKEN_BITS)
    for a, b in blocks(offs_all, rows=1 << (64 - TOKEN_BITS - 1)):
        raw, offs = raw_all[offs_all[a] : offs_all[b]], offs_all[a : b + 1] - offs_all[a]
        starts, ends, first = word_spans(raw, offs)
        count = np.diff(first)
        sh, rows = ngram_hashes(word_hashes(raw, starts, ends), first, n)
        if salt:
            sh = mix(sh + _U(salt))
        ok = count[rows] >= min_words
        key = np.sort((rows[ok].astype(np.uint64) << _U(TOKEN_BITS)) | (sh[ok] >> shift))
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        row = (key >> _U(TOKEN_BITS)).astype(np.int64)
        yield (a, b), count, np.bincount(row, minlength=b - a), (key & _U((1 << TOKEN_BITS) - 1)).astype(np.int64)
