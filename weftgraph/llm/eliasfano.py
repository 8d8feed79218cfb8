"""Elias-Fano sequences and an n-gram trie of two levels on them.

All arrays of a trie lie in one buffer, which may be bytes or a memory-mapped file; access is
vectorised over queries.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

U64 = np.uint64


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).astype(np.int64)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each 64-bit word."""
    pos = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (word >> pos.astype(np.uint64)) & U64((1 << width) - 1)
        n = _ones(low)
        up = k >= n
        k = np.where(up, k - n, k)
        pos = np.where(up, pos + width, pos)
    return pos


class EliasFano:
    """Non-decreasing uint64 values: low bits packed, high bits unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(_ones(high))])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top // n) if n else 0).bit_length() - 1)
        at = (values >> U64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, at // 64, U64(1) << (at % 64).astype(np.uint64))
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & U64((1 << low_bits) - 1)
            pos = np.arange(n, dtype=np.int64) * low_bits
            word, shift = pos // 64, (pos % 64).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift.astype(np.int64) + low_bits > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (U64(64) - shift[spill]))
        return cls(n, low_bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        pos = i * self.low_bits
        word, shift = pos // 64, (pos % 64).astype(np.uint64)
        out = self.low[word] >> shift
        over = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (out | over) & U64((1 << self.low_bits) - 1)

    def _select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, "right") - 1
        return word * 64 + _select_in_word(self.high[word], k - self.ones[word])

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select1(i) - i).astype(np.uint64) << U64(self.low_bits)) | self._low(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First index not below each x among the entries with its high part, and the end of these.

        The high part is found by selection, the low part by bisection over packed bits.
        """
        h = (x >> U64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        start = np.where(h > 0, self._select0(np.clip(h - 1, 0, last)) - (h - 1), 0)
        end = self._select0(np.clip(h, 0, last)) - h
        beyond = h > last
        start, end = np.where(beyond, self.n, start), np.where(beyond, self.n, end)
        want = x & U64((1 << self.low_bits) - 1)
        i, j = start.copy(), end.copy()
        live = np.flatnonzero(i < j)
        while len(live):
            mid = (i[live] + j[live]) // 2
            up = self._low(mid) < want[live]
            i[live[up]] = mid[up] + 1
            j[live[~up]] = mid[~up]
            live = live[i[live] < j[live]]
        return np.minimum(i, self.n), np.minimum(end, self.n)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and value of the first entry not below each x (n and 0 where there is none)."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
        i, _ = self._search(x)
        value = self.access(np.minimum(i, self.n - 1))
        return i, np.where(i < self.n, value, U64(0))

    def index_of(self, x: np.ndarray) -> np.ndarray:
        """First index of each x, -1 where it isn't an entry."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.full(len(x), -1, np.int64)
        i, end = self._search(x)
        at = np.minimum(i, self.n - 1)
        hit = (i < end) & (self._low(at) == (x & U64((1 << self.low_bits) - 1)))
        return np.where(hit, i, -1)

    def parts(self) -> tuple[dict, list[np.ndarray]]:
        return {"n": self.n, "low_bits": self.low_bits}, [self.low, self.high]


#: Probabilities are quantised to powers of 2 ** (-1 / STEPS), to the nearest: at most 2 ** (0.5 / STEPS) apart.
STEPS = 1024


def quantise(p: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the steps of the logarithm below 1; two bytes hold any share of a count."""
    p = np.asarray(p, np.float64)
    code = 1 - np.rint(STEPS * np.log2(np.where(p > 0, p, 1)))
    return np.where(p > 0, np.minimum(code, 65535), 0).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((1 - code.astype(np.float64)) / STEPS), 0.0)


class BigramTrie:
    """Contexts with their counts, their pointers, and the successors of each context with a quantised
    probability: their share of the context's count in this trie.

    The successors of a context are stored with the last value of the context before
    added, which makes the whole level monotone; a query adds the same value and looks
    for the successor within the context's range.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, totals: np.ndarray, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.totals, self.codes = contexts, pointers, successors, totals, codes

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, count: np.ndarray) -> BigramTrie:
        """From distinct (context, successor) in ascending order; successors of at most 40 bits."""
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(context))
        base = np.zeros(len(first), np.uint64)
        successor = successor + U64(1)  # never 0, so values of a context lie above its base
        if len(first):
            base[1:] = np.cumsum(successor[ends - 1])[:-1]
        values = successor + np.repeat(base, ends - first) if len(first) else successor
        totals = np.add.reduceat(count, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        share = count / np.repeat(totals, ends - first) if len(first) else np.zeros(0)
        return cls(EliasFano.encode(context[first]), EliasFano.encode(np.append(first, len(context)).astype(np.uint64)), EliasFano.encode(values), totals, quantise(share))

    def lookup(self, context: np.ndarray, runs: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the contexts, and codes of the successors, the first ``runs[0]`` of which belong to
        ``context[0]`` and so on; 0 where a context or a bigram isn't in the trie."""
        total, out = np.zeros(len(context), np.int64), np.zeros(len(successor), np.uint16)
        i = self.contexts.index_of(context)
        if not len(i) or not self.successors.n:
            return total, out
        known = np.maximum(i, 0)
        total = np.where(i >= 0, self.totals[known], 0)
        lo, hi = (self.pointers.access(known + k).astype(np.int64) for k in (0, 1))
        base = np.where(lo > 0, self.successors.access(np.maximum(lo - 1, 0)), U64(0))
        hi = np.where(i >= 0, hi, 0)
        which = np.repeat(np.arange(len(i)), runs)
        ask = np.flatnonzero(i[which] >= 0)
        which = which[ask]
        at = self.successors.index_of(base[which] + successor[ask] + U64(1))
        hit = (at >= lo[which]) & (at < hi[which])
        out[ask[hit]] = self.codes[at[hit]]
        return total, out

    def to_bytes(self) -> bytes:
        head, body = [], []
        for part in (self.contexts, self.pointers, self.successors):
            meta, arrays = part.parts()
            head.append(meta | {"words": [len(a) for a in arrays]})
            body += arrays
        raw = json.dumps({"levels": head, "totals": len(self.totals), "codes": len(self.codes)}).encode()
        raw += b" " * (-(8 + len(raw)) % 8)
        return len(raw).to_bytes(8, "little") + raw + b"".join(a.tobytes() for a in body) + self.totals.tobytes() + self.codes.tobytes()

    @classmethod
    def from_buffer(cls, buffer) -> BigramTrie:
        """Over bytes or a memory map, without copies of the levels."""
        data = np.frombuffer(buffer, np.uint8) if not isinstance(buffer, np.ndarray) else buffer
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())
        at, parts = 8 + size, []
        for level in head["levels"]:
            arrays = []
            for n in level["words"]:
                arrays.append(data[at : at + 8 * n].view(np.uint64))
                at += 8 * n
            parts.append(EliasFano(level["n"], level["low_bits"], *arrays))
        totals = data[at : at + 8 * head["totals"]].view(np.int64)
        at += 8 * head["totals"]
        return cls(*parts, totals, data[at : at + 2 * head["codes"]].view(np.uint16))

    @classmethod
    def open(cls, path: str) -> BigramTrie:
        return cls.from_buffer(np.memmap(path, np.uint8, "r"))

    def mapped(self) -> BigramTrie:
        """The same trie over an anonymous memory map, which holds nothing but its compact levels."""
        raw = self.to_bytes()
        room = mmap.mmap(-1, len(raw))
        room.write(raw)
        return self.from_buffer(room)
