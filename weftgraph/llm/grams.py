"""Hashed byte n-gram counts of texts, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

ROWS = 512


def counts(column: pa.Array, bits: int, case: np.ndarray, sizes: tuple[int, ...] = (3,)) -> np.ndarray:
    """Rows by 2**bits matrix of n-gram counts (float32), 65535 at most in training and use alike; n-grams don't cross rows."""
    data, off = tk.text_bytes(column)
    n, d = len(off) - 1, 1 << bits
    out = np.zeros((n, d), np.float32)
    for i, j in tk.slices(off):
        x = case[data[off[i] : off[j]]].astype(np.uint32)
        o = off[i : j + 1] - off[i]
        row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(o))
        total = np.zeros((j - i) * d, np.int64)
        for size in sizes:
            if len(x) < size:
                continue
            m = len(x) - size + 1
            h = np.full(m, size, np.uint32)
            for k in range(size):
                h = h * np.uint32(0x01000193) + x[k : k + m] * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            ok = row[:m] == row[size - 1 :]
            total += np.bincount(row[:m][ok] * d + (h[ok] >> np.uint32(32 - bits)).astype(np.int64), minlength=len(total))
        out[i:j] = np.minimum(total, 65535).reshape(j - i, d)
    return out


def row_batches(batches, text_col: str, limit: int = tk.SLICE_BYTES):
    """Batches cut to bounded bytes and rows, so that dense features stay small."""
    for batch in batches:
        for part in tk.sub_batches(batch, text_col, limit) if batch.num_rows else ():
            for i in range(0, part.num_rows, ROWS):
                yield part.slice(i, ROWS)


def collect_features(rows: DataFrame, text_col: str, keep: list[str], make) -> tuple[np.ndarray, list[tuple]]:
    """Feature vectors (counts of two bytes) of a bounded sample, made on the executors, and the columns ``keep``."""
    kept = rows.select(*keep, text_col)
    at = kept.schema.names.index(text_col)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.drop(text_col).schema.fields) + ", _x binary"

    def run(batches):
        for part in row_batches(batches, text_col):
            x = make(part.column(at)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), tk.binary_array([r.tobytes() for r in x])], names=[*keep, "_x"])

    got = kept.mapInArrow(run, schema).toArrow()
    order = np.lexsort([np.asarray(got.column(k).to_pylist()) for k in reversed(keep)]) if got.num_rows else []
    rows_ = list(zip(*(got.column(k).to_pylist() for k in keep), strict=True))
    x = np.frombuffer(b"".join(got.column("_x").to_pylist()), np.uint16).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 0), np.uint16)
    return x[order].astype(np.float32) if len(x) else np.zeros((0, 0), np.float32), [rows_[i] for i in order]
