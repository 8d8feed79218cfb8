"""Exact top-k inner products by columnar branch-and-bound.

Queries and candidates are dealt into cells of a grid, so a task holds one
bounded block of each.  In a cell, scores are accumulated dimension block by
dimension block over a vertical (dimension-major) layout; after each block the
Cauchy-Schwarz mass of the dimensions still to come bounds every score from above,
and pairs below the query's current k-th score are compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Largest blocks of a cell, in vectors.
CELL_CANDIDATES, CELL_QUERIES = 65536, 4096
DIM_BLOCK, QUERY_TILE, CANDIDATE_TILE = 16, 256, 4096
#: Pairs are compacted once at most this share of a tile survives.
COMPACT_BELOW = 0.05


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Rows of floor(scale * x); shorter vectors end in zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    lens = np.asarray(arr.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.floor(scale * np.asarray(arr.flatten().to_numpy(zero_copy_only=False), np.float64))
    d = int(lens.max(initial=0))
    out = np.zeros((len(lens), d))
    out[np.arange(d)[None, :] < lens[:, None]] = flat
    return out


def _keep_best(q, score, cid, k):
    """The k best of each q by (score descending, id ascending)."""
    order = np.lexsort((cid, -score, q))
    q, score, cid = q[order], score[order], cid[order]
    first = np.searchsorted(q, q)
    ok = np.arange(len(q)) - first < k
    return q[ok], score[ok], cid[ok]


def search_cell(qid: np.ndarray, qm: np.ndarray, cid: np.ndarray, cm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of query, score, id) of the k best candidates of each query."""
    d = max(qm.shape[1], cm.shape[1])
    qm, cm = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (qm, cm))
    top = float(np.abs(qm).max(initial=0) * np.abs(cm).max(initial=0) * max(d, 1))
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    if top >= 2**63:
        raise ValueError("scores do not fit in 64 bits")
    spread = np.argsort(-(cm**2).sum(0), kind="stable")  # heaviest dimensions first
    qm, cm = np.ascontiguousarray(qm[:, spread].astype(kind)), np.ascontiguousarray(cm[:, spread].T.astype(kind))
    cuts = [*range(0, d, DIM_BLOCK), d]

    def rest(m: np.ndarray, axis: int) -> list[np.ndarray]:
        """Norms of the dimensions after each block, rounded up."""
        sq = m.astype(np.float64) ** 2
        return [(np.sqrt(np.take(sq, range(c, d), axis=axis).sum(axis)) * (1 + 1e-5)).astype(np.float32) for c in cuts[1:]]

    q_rest, c_rest = rest(qm, 1), rest(cm, 0)
    out = []
    for a in range(0, len(qid), QUERY_TILE):
        q = qm[a : a + QUERY_TILE]
        n = len(q)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        tau = np.full(n, -np.inf)
        for b in range(0, cm.shape[1], CANDIDATE_TILE):
            c, ids = cm[:, b : b + CANDIDATE_TILE], cid[b : b + CANDIDATE_TILE]
            width = c.shape[1]
            part, pairs = np.zeros((n, width), kind), None
            for j, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if pairs is None:
                    part += q[:, lo:hi] @ c[lo:hi]
                    if hi < d and np.isfinite(tau).all():
                        bound = np.multiply.outer(q_rest[j][a : a + n], c_rest[j][b : b + width])
                        bound += part
                        alive = bound >= (tau - 0.5 - 1e-6 * np.abs(tau))[:, None]
                        if np.count_nonzero(alive) <= COMPACT_BELOW * alive.size:
                            pairs = np.nonzero(alive)
                            got = part[pairs]
                else:
                    qi, ci = pairs
                    got = got + (q[qi, lo:hi] * c[lo:hi, ci].T).sum(1)
                    ok = got + q_rest[j][a + qi] * c_rest[j][b + ci] >= tau[qi] - 0.5 - 1e-6 * np.abs(tau[qi])
                    pairs, got = (qi[ok], ci[ok]), got[ok]
            if pairs is None:
                floor = tau
                own = int(np.unique(ids, return_counts=True)[1].max())
                if width > k + own:  # the k-th best of the tile, own rows left aside
                    floor = np.maximum(tau, np.partition(part, width - k - own, axis=1)[:, width - k - own])
                pairs = np.nonzero(part >= floor[:, None])
                got = part[pairs]
            qi, ci = pairs
            other = qid[a + qi] != ids[ci]
            qi, ci, got = qi[other], ci[other], got[other]
            best = _keep_best(np.concatenate([best[0], qi]), np.concatenate([best[1], got.astype(np.int64)]), np.concatenate([best[2], ids[ci]]), k)
            full = np.bincount(best[0], minlength=n) >= k
            last = np.searchsorted(best[0], np.arange(n), "right") - 1
            tau[full] = best[1][last[full]]
        out.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every query.

    Components become floor(scale * x); vectors that are null or hold null or
    non-finite components take no part, shorter ones end in zeros, and an empty vector
    scores 0.  Rows with the id of a query are not its candidates; ties go to the smaller
    id; repeated candidate rows count once each.  Scores beyond 64 bits raise an error.
    """
    spark = vectors.sparkSession
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def parts(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)

    c, q = parts(vectors), parts(queries)
    n, nq = c.count(), q.count()
    across = max(1, -(-n // CELL_CANDIDATES), min(partitions(spark), -(-n // 2048)))
    down = max(1, -(-nq // CELL_QUERIES))
    c = c.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(across)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("b"), "id", "v")
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(down)).cast("int").alias("b"), "id", "v")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        cid, qid = (np.asarray(t["id"].to_numpy(), np.int64) for t in (left, right))
        if not len(cid) or not len(qid):
            at, score, got = (np.zeros(0, np.int64),) * 3
        else:
            at, score, got = search_cell(qid, _matrix(right["v"], scale), cid, _matrix(left["v"], scale), k)
        return pa.table({"query_id": pa.array(qid[at], pa.int64()), "vec_id": pa.array(got, pa.int64()), "score": pa.array(score, pa.int64())})

    found = c.groupBy("a", "b").cogroup(q.groupBy("a", "b")).applyInArrow(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(v, v.filter(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
