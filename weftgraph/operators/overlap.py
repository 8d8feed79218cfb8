"""Pairs of keys with overlapping shingle sets, found by the shingles that two of them share first.

With one order of all shingles, sets that share t of them share two among the first n - t + 2 of each.  So
pairs of these are signatures: the larger set of a pair asks with the prefix that any smaller set needs, the
smaller answers with the prefix that any larger one needs.  Random keys hardly share two rare shingles, so
candidates stay few where single shingles would meet in every pair.  Tasks exchange signatures packed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import stored

BUCKETS = 1 << 16  # of shingles, counted together for the order by rarity
KEYS, ENTRIES, CANDIDATES = 1 << 16, 3_000_000, 2_000_000  # at a time: keys packed, signatures of a part, candidates expanded
ROUND = 1_000_000_000  # bytes of signatures exchanged at a time, or 100 a key; the parts take turns beyond
FEW = 500_000  # keys of candidates that are sent to every task
U64 = np.uint64
_NONE = U64(0x1FFFFF)  # no character


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def sets_of(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of three characters, without blanks, as numbers; shorter keys are one shingle."""
    bare = [k.replace(" ", "") for k in keys]
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    chars = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    chars = np.append(chars, [_NONE] * 3)
    n = np.maximum(size - 2, 1)
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(bare)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = first[row] + place
    part = [np.where(place + i < size[row], chars[np.minimum(at + i, len(chars) - 1)], _NONE) for i in range(3)]
    code = _mix((part[0] << U64(42)) | (part[1] << U64(21)) | part[2])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> U64(48)).astype(np.int64)


def _signatures(code: np.ndarray, first: np.ndarray, row: np.ndarray, prefix: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the combinations of ``together`` shingles in the prefix of each of the rows."""
    rows, sigs = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for length in np.unique(prefix):
        if length < together:
            continue
        own = row[prefix == length]
        grid = code[first[own][:, None] + np.arange(length)]
        if together == 1:
            sig = _mix(grid + U64(1))
        else:
            i, j = np.triu_indices(length, 1)
            sig = _mix(_mix(grid[:, i]) + grid[:, j])
        rows.append(np.repeat(own, sig.shape[1]))
        sigs.append(sig.ravel())
    return np.concatenate(rows), np.concatenate(sigs)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(x - 1e-9), 1).astype(np.int64)  # rounding may add a shingle to a prefix, never take one


def signatures(keys: list[str], often: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, signature) that answer, and that ask."""
    row, code = sets_of(keys)
    row_order = np.lexsort((code, often[_bucket(code)], row))
    code = code[row_order]
    n = np.bincount(row, minlength=len(keys))
    first, every = np.cumsum(n) - n, np.arange(len(keys))
    larger, smaller = _ceil(2 * least / (1 + least) * n), _ceil(least * n)  # shared at least with a larger set, with a smaller set
    few = int(math.floor(1 / least + 1e-9))  # sets so small may share a single shingle
    one, two = n <= few, n >= 2
    answer = [_signatures(code, first, every[one], (n - larger + 1)[one], 1), _signatures(code, first, every[two], (n - np.maximum(larger, 2) + 2)[two], 2)]
    single = smaller == 1
    ask = [_signatures(code, first, every[single], n[single], 1), _signatures(code, first, every[~single], (n - smaller + 2)[~single], 2)]
    return [tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in (answer, ask)]


def _batches(tables, rows: int):
    """Record batches joined until they have so many rows."""
    held, n = [], 0
    for b in tables:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _expand(found: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places found, found + 1, ... of each run."""
    return np.repeat(found - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _matches(answer: tuple[np.ndarray, np.ndarray], ask: tuple[np.ndarray, np.ndarray]):
    """(a, b) of different rows that share a signature, once in each slice, by askers."""
    order = np.argsort(answer[0])
    sig, ref = answer[0][order], answer[1][order]
    order = np.argsort(ask[1])
    ask_sig, ask_ref = ask[0][order], ask[1][order]
    low = np.searchsorted(sig, ask_sig, "left")
    many = np.searchsorted(sig, ask_sig, "right") - low
    hit = np.flatnonzero(many)
    low, many, ask_ref = low[hit], many[hit], ask_ref[hit]
    ends = np.cumsum(many)
    start = 0
    while start < len(many):
        done = ends[start] - many[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + CANDIDATES, "right")))
        x, y = np.repeat(ask_ref[start:stop], many[start:stop]), ref[_expand(low[start:stop], many[start:stop])]
        a, b = np.minimum(x, y), np.maximum(x, y)
        keep = a != b
        a, b = a[keep], b[keep]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield a[new], b[new]
        start = stop


def candidates(numbered: DataFrame, rows: int, least: float) -> DataFrame:
    """(ra, rb): numbers of keys (ref, key) that may have a Jaccard similarity of ``least``; all that have it are among them."""
    spark = numbered.sparkSession

    def count(tables):
        total = np.zeros(BUCKETS, np.int64)
        for t in _batches(tables, KEYS):
            total += np.bincount(_bucket(sets_of(t.column("key").to_pylist())[1]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    often = np.zeros(BUCKETS, np.int64)
    for r in numbered.select("key").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        often[r[0]] = r[1]
    mean = often.sum() / max(rows, 1)
    each = sum(x * x / 2 for x in (mean * (1 - 2 * least / (1 + least)) + 2, mean * (1 - least) + 2))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * each / ENTRIES))

    rounds = min(parts, max(1, math.ceil(6 * rows * each / max(ROUND, 100 * rows))))

    def pack(tables, turn):
        for t in _batches(tables, KEYS):
            refs, keys = t.column("ref").to_numpy(), t.column("key").to_pylist()
            block = refs >> 16  # numbers of one task follow each other
            for base in np.unique(block):
                own = np.flatnonzero(block == base)
                off = (refs[own] & 0xFFFF).astype(np.uint16)
                sides = []
                for row, sig in signatures([keys[i] for i in own], often, least):
                    part = ((sig >> U64(32)) % U64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[order], np.arange(parts + 1))
                    sides.append((sig[order].astype(np.uint32), off[row[order]], cut))
                out = [[], [], [], [], []]
                for p in range(turn, parts, rounds):
                    out[0].append(p)
                    for k, (sig, ref, cut) in enumerate(sides):
                        out[1 + 2 * k].append(sig[cut[p] : cut[p + 1]].tobytes())
                        out[2 + 2 * k].append(ref[cut[p] : cut[p + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([int(base) << 16] * len(out[0]), pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["part", "base", "s0", "r0", "s1", "r1"])

    def match(tables):
        sides = [([], []), ([], [])]
        for t in tables:
            part, base = t.column("part").to_pylist(), t.column("base").to_pylist()
            for k, (sigs, refs) in enumerate(sides):
                for p, b, s, r in zip(part, base, t.column(f"s{k}"), t.column(f"r{k}"), strict=True):
                    sigs.append(np.frombuffer(s.as_buffer(), np.uint32).astype(U64) | U64(p << 32))
                    refs.append(np.frombuffer(r.as_buffer(), np.uint16).astype(np.int64) + b)
        if sides[0][0]:
            for a, b in _matches(*(tuple(np.concatenate(x) for x in side) for side in sides)):
                for i in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["ra", "rb"])

    found = None
    for turn in range(rounds):
        packed = numbered.mapInArrow(lambda tables, turn=turn: pack(tables, turn), "part int, base long, s0 binary, r0 binary, s1 binary, r1 binary")
        some = packed.repartition(-(-parts // rounds), "part").mapInArrow(match, "ra long, rb long").distinct()
        some = some if rounds == 1 else stored(some, "candidates")
        found = some if found is None else found.union(some)
    return found if rounds == 1 else found.distinct()


def _set(key: str) -> set[str]:
    bare = key.replace(" ", "")
    return {bare[i : i + 3] for i in range(len(bare) - 2)} or {bare}


@F.pandas_udf(T.DoubleType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = _set(x), _set(y)
        shared = len(x & y)
        out.append(shared / (len(x) + len(y) - shared))
    return pd.Series(out, dtype="float64")


def similar_pairs(keys: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap): distinct keys whose shingle sets have a Jaccard similarity of ``least`` or more, above 0; exact."""
    numbered = stored(keys.filter("key IS NOT NULL").select(F.monotonically_increasing_id().alias("ref"), "key"), "keys")
    near = stored(candidates(numbered, numbered.count(), least), "candidates")
    ends = near.select(F.explode(F.array("ra", "rb")).alias("ref")).distinct()
    if ends.limit(FEW + 1).count() <= FEW:  # else all keys are dealt out
        numbered = stored(numbered.join(F.broadcast(ends), "ref", "left_semi"), "keys")
    for side in ("a", "b"):
        near = near.join(numbered.select(F.col("ref").alias(f"r{side}"), F.col("key").alias(f"k{side}")), f"r{side}")
    both = near.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return both.withColumn("overlap", _overlap("a", "b")).filter(F.col("overlap") >= least)
