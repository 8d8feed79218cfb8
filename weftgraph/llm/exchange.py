"""Exchange of packed keys between chunks of documents and buckets of keys.

Documents are dealt into chunks of a bounded size by a hash of id and text, so rows that share
an id, or have none, don't gather; only repeated rows share a chunk.  A chunk sends its
distinct keys, packed, to buckets of keys; a bucket answers each chunk with one
value for each key in the order it came.  A key that is frequent in the corpus comes at most once from each
chunk, so hot keys don't gather rows.  The chunk exchange of the documents is
the same plan wherever it is used, and Spark runs it once.

With many more buckets than keys in a chunk, a message holds a single key: the exchange then
works like a plain shuffle of keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import partitions, text_size

def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(chunk, id, text), with ``extra`` columns, and the number of chunks."""
    n = max(partitions(docs.sparkSession), -(-text_size(docs, text_col) // chunk_bytes))
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(23)), F.lit(n)).cast("int")
    own = docs.select(key.alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in (extra or {}).items()))
    return own.repartition(n, "chunk"), n  # as many tasks as chunks, whatever the setting, so none grows with the input


def bucket_slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """n + 1 offsets of the buckets in ascending uint64 keys (equal ranges of keys)."""
    step = (1 << 64) // buckets + 1
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def ids_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk (0 for null), and which are not null; the chunk is sorted by id first."""
    col = t.column("id").combine_chunks()
    return np.asarray(col.fill_null(0).to_numpy(zero_copy_only=False), np.int64), ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool)


def in_order(t: pa.Table) -> pa.Table:
    """The rows of a chunk in an order that doesn't depend on the shuffle."""
    if t.num_rows == 0:
        return t
    text = t.column("text")
    t = t.append_column("_len", pa.compute.fill_null(pa.compute.binary_length(text), -1))
    order = pa.compute.sort_indices(t.select(["id", "_len"]), sort_keys=[("id", "ascending"), ("_len", "ascending")])
    return t.take(order)


def chunk_words(t: pa.Table, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk's texts, split at ASCII white space, and word offsets of the rows."""
    parts, offs, total = [], [np.zeros(1, np.int64)], 0
    for piece in t.column("text").chunks:
        h, off = tk.hash_words(piece, tk.NONSPACE, case)
        parts.append(h)
        offs.append(off[1:] + total)
        total += len(h)
    return (np.concatenate(parts) if parts else np.zeros(0, tk.U64)), np.concatenate(offs)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def column(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    """A binary column as one array for each row."""
    return [np.frombuffer(v, kind) for v in t.column(name).to_pylist()]
