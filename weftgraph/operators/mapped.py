"""Graphs with numbered nodes in files of the shared folder, which the tasks of a machine map together.

Ids are dealt out once, to be numbered; edges meet their numbers by a sorted array of hashes, so that only pairs of
numbers are exchanged.  Where the shared folder is no mounted one, the arrays are broadcast.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import discard, shared_dir, stored
from .overlap import _batches
from .packed import ENTRIES

ROWS = 2_000_000  # edges that a task packs at a time


class Arrays:
    """Named arrays that the driver writes and tasks read."""

    def __init__(self, spark: SparkSession, label: str):
        root = urlparse(shared_dir(spark))
        self.folder = str(Path(unquote(root.path)) / f"graph-{label}-{uuid.uuid4().hex}") if root.scheme in ("", "file") else None
        self.kinds, self.held, self.sent = {}, {}, None
        if self.folder:
            os.makedirs(self.folder)

    def add(self, name: str, part: np.ndarray) -> None:
        """Appends to an array."""
        self.kinds[name] = part.dtype.str
        if self.folder:
            with open(f"{self.folder}/{name}", "ab") as f:
                f.write(np.ascontiguousarray(part).data)
        else:
            self.held.setdefault(name, []).append(part)

    def ready(self, spark: SparkSession) -> Arrays:
        if not self.folder:
            self.sent, self.held = spark.sparkContext.broadcast({k: np.concatenate(v) for k, v in self.held.items()}), {}
        return self

    def __getitem__(self, name: str) -> np.ndarray:
        if not self.folder:
            return self.sent.value[name]
        path = f"{self.folder}/{name}"
        return np.memmap(path, self.kinds[name], "r") if os.path.getsize(path) else np.zeros(0, self.kinds[name])

    def remove(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
        elif self.sent:
            self.sent.destroy()


def _hashes(numbers: DataFrame) -> Arrays | None:
    """Sorted hashes of the ids and the number of each; None if two ids share a hash."""
    parts = [], []
    for r in numbers.select(F.xxhash64("id").alias("h"), "n").mapInArrow(lambda bs: (pa.RecordBatch.from_pylist([{"h": t.column("h").to_numpy().tobytes(), "n": t.column("n").to_numpy().astype(np.int32).tobytes()}]) for t in _batches(bs, ROWS)), "h binary, n binary").toLocalIterator():
        parts[0].append(np.frombuffer(r[0], np.int64))
        parts[1].append(np.frombuffer(r[1], np.int32))
    h, n = (np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, (np.int64, np.int32), strict=True))
    order = np.argsort(h)
    h = h[order]
    if (h[1:] == h[:-1]).any():
        return None
    out = Arrays(numbers.sparkSession, "hashes")
    out.add("h", h)
    out.add("n", n[order])
    return out.ready(numbers.sparkSession)


class Graph:
    """``arrays`` has the neighbours ``near`` of each node, ``many`` from ``start`` on, in ascending order, once each."""

    def __init__(self, arrays: Arrays, nodes: int, edges: int):
        self.arrays, self.nodes, self.edges = arrays, nodes, edges

    def load(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.arrays[x] for x in ("start", "many", "near"))


def graph(edges: DataFrame, numbers: DataFrame, nodes: int, most: int) -> Graph | None:
    """The edges (id, other), in the directions given and once each; None if there are more than ``most`` or ids can't be told apart."""
    spark = edges.sparkSession
    known = _hashes(numbers)
    if known is None:
        return None
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // ENTRIES))
    span = max(1, -(-nodes // (16 * parts)))  # of the nodes in a block; blocks are many, as nodes with many edges lie together

    def pack(tables):
        h, n = known["h"], known["n"]
        for t in _batches(tables, ROWS):
            both, place = np.unique(np.concatenate([t.column(c).to_numpy() for c in "ab"]), return_inverse=True)
            number = n[np.searchsorted(h, both)].astype(np.int64)[place]
            key = np.unique((number[: t.num_rows] << 32) | number[t.num_rows :])
            block, v = (key >> 32) // span, key.astype(np.int32)
            u = (key >> 32).astype(np.int32)
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            end = np.append(cut[1:], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int32)), *(pa.array([x[i:j].tobytes() for i, j in zip(cut, end, strict=True)], pa.binary()) for x in (u, v))], names=["block", "u", "v"])

    def merge(tables):
        held = {}
        for t in tables:
            for b, u, v in zip(*(t.column(c).to_pylist() for c in ("block", "u", "v")), strict=True):
                held.setdefault(b, []).append((u, v))
        for b in sorted(held):
            u, v = (np.frombuffer(b"".join(x), np.int32) for x in zip(*held.pop(b), strict=True))
            key = np.unique((u.astype(np.int64) << 32) | v)
            many = np.bincount((key >> 32) - b * span, minlength=span).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (many, key.astype(np.int32)))], names=["block", "many", "near"])

    hashed = edges.select(F.xxhash64("id").alias("a"), F.xxhash64("other").alias("b"))
    blocks = stored(hashed.mapInArrow(pack, "block int, u binary, v binary").repartition(parts, "block").mapInArrow(merge, "block int, many binary, near binary"), "blocks")
    known.remove()
    out, start, many, total = Arrays(spark, "edges"), np.zeros(nodes, np.int64), np.zeros(nodes, np.int32), 0
    out.add("near", np.zeros(0, np.int32))
    for b, own, near in blocks.toLocalIterator():
        if total > most:
            break
        at = slice(b * span, min((b + 1) * span, nodes))
        many[at] = np.frombuffer(own, np.int32)[: at.stop - at.start]
        start[at] = total + np.cumsum(many[at], dtype=np.int64) - many[at]
        out.add("near", np.frombuffer(near, np.int32))
        total += len(near) // 4
    discard(blocks)
    if total > most:
        out.remove()
        return None
    out.add("start", start)
    out.add("many", many)
    return Graph(out.ready(spark), nodes, total)


def runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def slices(many: np.ndarray, most: int):
    """Ranges of nodes with up to so many edges, one node at least."""
    ends, at = np.cumsum(many, dtype=np.int64), 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + most, "right")))
        yield at, stop
        at = stop
