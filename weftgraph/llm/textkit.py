"""Vectorised word handling over Arrow string columns.

Word classes of the operators are sets of ASCII bytes, and every byte of a
multi-byte UTF-8 character is 0x80 or more, so splitting bytes splits characters
exactly.  Words are identified by 64-bit hashes computed with prefix sums of a
polynomial modulo 2**64 (no Python loop per word); operators that need certainty
compare the bytes afterwards.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once; bounds the power tables and temporaries.
SLICE_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after lower-casing A-Z
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: ``[^\x20\x09-\x0D]``
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x20] = False
NONSPACE[0x09:0x0E] = False

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, dtype=U64)
_IPOW = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + 4096)
        with np.errstate(over="ignore"):
            base = np.full(size, _P, dtype=U64)
            base[0] = 1
            _POW = np.cumprod(base, dtype=U64)
            base[1:] = _P_INV
            _IPOW = np.cumprod(base, dtype=U64)
    return _POW, _IPOW


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each (a longer row alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and n + 1 word offsets of the rows."""
    w = is_word[data]
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    st, en = w.copy(), w.copy()
    st[1:] &= ~w[:-1]
    en[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    st[cut] |= w[cut]
    en[cut - 1] |= w[cut - 1]
    starts = np.flatnonzero(st)
    return starts, np.flatnonzero(en) + 1, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span of ``data`` (already case-mapped)."""
    pow_, ipow = _powers(len(data) + 1)
    cs = np.empty(len(data) + 1, dtype=U64)
    cs[0] = 0
    np.cumsum(_BYTE[data] * pow_[: len(data)], out=cs[1:])
    return mix((cs[ends] - cs[starts]) * ipow[starts] + (ends - starts).astype(U64))


def hash_words(column: pa.Array, is_word: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the words of a string column, and the n + 1 word offsets of its rows."""
    data, off = text_bytes(column)
    parts, woff = [], np.zeros(len(off), np.int64)
    total = 0
    for i, j in slices(off):
        piece = case[data[off[i] : off[j]]]
        s, e, wo = spans(piece, off[i : j + 1] - off[i], is_word)
        parts.append(span_hashes(piece, s, e))
        woff[i + 1 : j + 1] = total + wo[1:]
        total += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), woff


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries of ``h`` (rows not regarded)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out = out * U64(0x2545F4914F6CDD1D) + h[k : k + m]
    return mix(out)


def per_row_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, empty rows included."""
    cs = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=cs[1:])
    return cs[off[1:]] - cs[off[:-1]]


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each row's values; ``empty`` for rows without any."""
    out = np.full(len(off) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, off[full])
    return out


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the index repeated c times, and 0..c-1 within each."""
    idx = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return idx, np.arange(len(idx)) - before[idx]


def binary_array(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


def sub_batches(batch: pa.RecordBatch, text_col: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes each."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
    for i, j in slices(off, limit):
        yield batch.slice(i, j - i)


def _trim() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def handing_back(run: Callable):
    """A mapInArrow function that leaves no free memory in the worker, which serves the next task too."""

    def wrapped(batches):
        yield from run(batches)
        _trim()

    return wrapped


def appending(fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], text_col: str, limit: int = SLICE_BYTES):
    """A mapInArrow function that adds the columns ``fn`` makes to every batch."""

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, text_col, limit) if batch.num_rows else ():
                new = fn(part)
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*part.schema.names, *new.keys()])

    return handing_back(run)
