"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents is turned into byte-trigram counts, weighted by
tf-idf, joined with a few shares of style (repetition, capitals, signs) and reduced by a truncated singular value decomposition.  The labelled
vectors are broadcast (their size is fixed by the parameters), and each document,
whole, is projected and compared with all of them by exact cosine products, block by block.
The nearest neighbours vote with their similarity, each label weighted by how much
rarer it is in the sample than among all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from . import textkit as tk
from .common import crc_mod, table, with_fields

BITS = 10
#: Number of style shares, and their weight against the text's unit vector.
STYLE, STYLE_WEIGHT = 6, 2.0


def style(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of: words equal to the one before, lines seen before in the
    text, capitals, ASCII signs, digits and very long words.  Zeros for empty texts."""
    data, off = tk.text_bytes(column)
    out = np.zeros((len(off) - 1, STYLE), np.float32)
    for i, j in tk.slices(off):
        x, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, wo = tk.spans(x, o, tk.NONSPACE)
        h = tk.span_hashes(x, s, e)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[wo[:-1][wo[:-1] < len(h)]] = False
        ls, le, lo = tk.spans(x, o, _LINE)
        row = np.repeat(np.arange(j - i), np.diff(lo))
        lh = tk.span_hashes(x, ls, le)
        order = np.lexsort((lh, row))
        again = np.zeros(len(lh), bool)
        again[1:] = (lh[order][1:] == lh[order][:-1]) & (row[order][1:] == row[order][:-1])
        size, words, lines = (np.maximum(1, np.diff(v)) for v in (o, wo, lo))
        out[i:j] = np.sqrt(np.stack([tk.per_row_sum(same, wo) / words, np.bincount(row[order][again], minlength=j - i) / lines, tk.per_row_sum(_CAPITAL[x], o) / size, tk.per_row_sum(_SIGN[x], o) / size, tk.per_row_sum(_DIGIT[x], o) / size, tk.per_row_sum(e - s > 40, wo) / words], 1))
    return out


_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
_CAPITAL, _DIGIT, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = _DIGIT[48:58] = True
_SIGN[33:128] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False


def features(column: pa.Array) -> np.ndarray:
    """Byte-trigram counts, then the style shares scaled to 16-bit counts."""
    return np.hstack([grams.counts(column, BITS, tk.SAME), np.round(style(column) * 60000)])


class LatentVoting:
    """Fitted model: idf, projection, labelled vectors, labels and their weights."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, prior: float, rank: int, neighbours: int):
        self.prior, self.k = prior, neighbours
        df = (x[:, : 1 << BITS] > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        w = self._weigh(x)
        vals, vecs = np.linalg.eigh((w.T @ w).astype(np.float64))
        top = np.argsort(-vals)[: min(rank, len(x))]
        self.project = vecs[:, top].astype(np.float32)
        self.points = self._unit(w @ self.project)
        self.labels = labels.astype(np.float32)
        ones = float(labels.mean())
        self.weight = np.where(labels == 1, prior / max(ones, 1e-9), (1 - prior) / max(1 - ones, 1e-9)).astype(np.float32)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        terms = self._unit(np.log1p(x[:, : 1 << BITS]) * self.idf)
        return self._unit(np.hstack([terms, STYLE_WEIGHT * x[:, 1 << BITS :] / 60000]))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(n > 0, n, 1)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 in the votes; the prior where nothing is similar."""
        v = self._unit(self._weigh(x) @ self.project)
        sim = v @ self.points.T
        k = min(self.k, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        # of points as similar as the last of them, the first ones vote
        least = np.take_along_axis(sim, near, 1).min(1, keepdims=True)
        tied = np.flatnonzero((sim >= least).sum(1) > k)
        near[tied] = np.argsort(-sim[tied], axis=1, kind="stable")[:, :k]
        s = np.maximum(np.take_along_axis(sim, near, 1), 0) ** 8 * self.weight[near]
        total = s.sum(1)
        return np.where(total > 0, (s * self.labels[near]).sum(1) / np.where(total > 0, total, 1), self.prior).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2000, rank: int = 24, neighbours: int = 9, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LatentVoting | None:
    """Learns from at most ``per_label`` rows of each label, the first by hash of the id.

    Rows with null id, text or label, or a label other than 0 and 1, are not used.  None if no row is left.
    """
    spark = docs.sparkSession
    sound = labels.select(id_col, label_col).filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    total = {r[0]: r[1] for r in sound.groupBy(label_col).agg(F.count(F.lit(1))).collect()}
    chosen = [r for y in (0, 1) for r in sound.filter(F.col(label_col) == y).orderBy(F.xxhash64(id_col), id_col).limit(per_label).collect()]
    if not chosen:
        return None
    ids = F.broadcast(spark.createDataFrame(chosen, sound.schema))  # 2 * per_label rows at most
    rows = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull()).join(ids, id_col)
    x, kept = grams.collect_features(rows, text_col, [id_col, label_col], features)
    if not len(x):
        return None
    y = np.array([r[1] for r in kept])
    return LatentVoting(x, y, total.get(1, 0) / sum(total.values()), rank, neighbours)


def classify(docs: DataFrame, model: LatentVoting | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on), named with ``prefix``.

    Null and empty texts, and all texts without a model, get the prior (0.5
    without a model).  Repeated rows get the same score.  Of labelled vectors with equal similarity, the first by id vote.  Columns with the new names are replaced.
    """
    names = [f"{prefix}score", f"{prefix}predicted"]
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.names.index(text_col)

    def run(batches):
        m = sent.value
        for part in grams.row_batches(batches, text_col):
            s = m.score(features(part.column(at))) if m else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs, (names[0], T.DoubleType()), (names[1], T.IntegerType())))


def model_of(docs: DataFrame, labels: DataFrame) -> LatentVoting | None:
    """Learns from rows whose crc32 of the id modulo 3 is not 1."""
    return fit(docs, labels.filter(crc_mod("doc_id", 3) != 1))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, model_of(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
