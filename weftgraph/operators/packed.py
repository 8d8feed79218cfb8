"""Graphs with numbered nodes: edges stay with the tasks as sorted arrays, node arrays are sent to all of them.

Numbers follow the order of the ids, so ties by number are ties by id.  Node arrays have a bound (``NODES``);
beyond it the operators work by joins of tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stored

NODES = 20_000_000  # most nodes whose arrays are sent to tasks
ENTRIES = 4_000_000  # edges in one block


def within(ids: DataFrame, most: int) -> bool:
    """Whether there are at most so many rows."""
    return ids.limit(most + 1).count() <= most


def numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """(id, n) of distinct ids, numbered from 0 in their order, and their count."""
    placed = stored(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("m")), "numbers")
    counts = dict(placed.groupBy(F.shiftright("m", 33)).count().collect())  # a row for each task
    offsets, total = [], 0
    for task in range(max(counts, default=-1) + 1):
        offsets.append(F.lit(total).cast("long"))
        total += counts.get(task, 0)
    at = F.array(*offsets)[F.shiftright("m", 33).cast("int")] if offsets else F.lit(0).cast("long")
    return placed.select("id", (at + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("n")), total


def ends(edges: DataFrame, numbers: DataFrame, *columns: str) -> DataFrame:
    """``edges`` with the numbers of the ids in the columns in their place."""
    for c in columns:
        edges = edges.join(numbers.select(F.col("id").alias(c), F.col("n").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return edges


def blocks(edges: DataFrame, nodes: int, weighted: bool) -> DataFrame:
    """(part, u, v, w) with the edges (u, v, w) of a range of u, sorted by u, as int32 and float64 arrays; w is null if not weighted."""
    kept = stored(edges, "numbered")
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // ENTRIES))
    span = max(1, -(-nodes // parts))

    def pack(tables):
        held = list(tables)
        if not held:
            return
        t = pa.Table.from_batches(held)
        u, v = (t.column(c).to_numpy().astype(np.int32) for c in "uv")
        w = t.column("w").to_numpy() if weighted else None
        part = u // span
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            own = own[np.lexsort((v[own], u[own]))]
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), *(pa.array([None if x is None else x[own].tobytes()], pa.binary()) for x in (u, v, w))], names=["part", "u", "v", "w"])

    dealt = kept.repartition(parts, F.floor(F.col("u") / span)).select("u", "v", *(["w"] if weighted else []))
    return stored(dealt.mapInArrow(pack, "part int, u binary, v binary, w binary"), "blocks")


def arrays(batch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(u, v, w) of the blocks in a record batch."""
    return [tuple(None if (x := row[c]) is None else np.frombuffer(x, np.float64 if c == "w" else np.int32) for c in "uvw") for row in batch.to_pylist()]


def run(df: DataFrame, work, schema: str) -> list:
    """Rows of ``work`` (u, v, w) -> tuple or None, for each block."""
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches):
        for b in batches:
            for block in arrays(b):
                yield pa.RecordBatch.from_pylist([dict(zip(names, work(*block), strict=True))])

    return df.mapInArrow(each, schema).collect()


def node_column(numbers: DataFrame, column: Column, kind, nodes: int) -> np.ndarray:
    """A number of each node, as an array."""
    out = np.zeros(nodes, kind)
    for r in numbers.select("n", column.cast("long").alias("x")).mapInArrow(lambda bs: (pa.RecordBatch.from_pylist([{"n": b.column("n").to_numpy().tobytes(), "x": b.column("x").to_numpy().astype(kind).tobytes()}]) for b in bs), "n binary, x binary").toLocalIterator():
        out[np.frombuffer(r[0], np.int32)] = np.frombuffer(r[1], kind)
    return out


def with_values(numbers: DataFrame, values: np.ndarray, name: str, kind: str, keep: np.ndarray | None = None) -> DataFrame:
    """(id, name): the value of each node, of those to keep."""
    sent = numbers.sparkSession.sparkContext.broadcast((values, keep))

    def look(batches):
        x, kept = sent.value
        for b in batches:
            n = b.column("n").to_numpy()
            out = pa.RecordBatch.from_arrays([b.column("id"), pa.array(x[n])], names=["id", name])
            yield out if kept is None else out.filter(pa.array(kept[n]))

    return numbers.mapInArrow(look, f"id string, {name} {kind}")
