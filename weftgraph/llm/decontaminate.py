"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark is cut into windows of ``window`` consecutive words.  The search
alphabet is the word: a block is two adjacent words.  ``shift`` tells for the
hashed block at the end of a window how far the search may jump; where it is 0
the suffix-hash bucket lists the windows that end in that block; the words of
window and text are then compared, first by hash and then byte by byte.

All the texts of a batch are searched at once: each run of 64 window positions is a
lane with its own position, and a step advances every lane by its own shift.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import discard, stored, text_size, with_fields

#: Text bytes of one block of benchmark items; each block is broadcast by itself.
BLOCK_BYTES = 8 << 20
LANE = 64
#: Pairs of position and window compared at once, and text bytes searched at once.
PAIRS, SEARCH_BYTES = 1 << 17, 1 << 18
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    """Words of one text, by the class of the contract."""
    data = tk.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = tk.spans(data, np.array([0, len(data)]), tk.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class WuManber:
    """Searcher for patterns that all have ``m`` words."""

    #: The table has about SPARSE entries for each block that ends a pattern, so most blocks of a text skip; 2 ** MOST at most.
    SPARSE, MOST = 16, 24

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.b = m, min(2, m)
        keys = list(patterns)
        flat = [w for k in keys for w in k]
        data = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum([len(w) for w in flat]).astype(np.int64)
        starts = ends - np.array([len(w) for w in flat], np.int64)
        self.data, self.starts, self.lens = data, starts.reshape(-1, m), (ends - starts).reshape(-1, m)
        h = np.concatenate([tk.span_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i in range(0, len(flat), 4096) for j in [min(i + 4096, len(flat))]])
        self.h = h.reshape(-1, m)
        self.bits = min(self.MOST, max(12, int(self.SPARSE * len(keys)).bit_length()))
        self.shift = np.full(1 << self.bits, min(255, m - self.b + 1), np.uint8)
        for j in range(m - self.b + 1):
            np.minimum.at(self.shift, self._block(self.h, j), min(255, m - self.b - j))
        last = self._block(self.h, m - self.b)
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]
        self.items = [patterns[k] for k in keys]

    def _block(self, h: np.ndarray, j: int) -> np.ndarray:
        first = h[..., j]
        x = first if self.b == 1 else first * tk.U64(0x9E3779B97F4A7C15) + h[..., j + 1]
        return (x >> tk.U64(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray, woff: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, pattern) of each occurrence within the rows given by ``woff``."""
        m, b = self.m, self.b
        room = np.maximum(woff[1:] - woff[:-1] - m + 1, 0)
        lane, nth = tk.expand(-(-room // LANE))
        p = woff[lane] + nth * LANE
        end = np.minimum(p + LANE, woff[lane] + room[lane])
        found = []
        while len(p):
            x = h[p + (m - b)]
            if b == 2:
                x = x * tk.U64(0x9E3779B97F4A7C15) + h[p + (m - 1)]
            block = (x >> tk.U64(64 - self.bits)).astype(np.int64)
            s = self.shift[block].astype(np.int64)
            zero = s == 0
            if zero.any():
                found.append((p[zero], block[zero]))
            p = p + np.maximum(s, 1)
            go = p < end
            p, end = p[go], end[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, block = (np.concatenate(x) for x in zip(*found, strict=True))
        lo = np.searchsorted(self.last, block)
        size = np.searchsorted(self.last, block, "right") - lo
        total, out = np.cumsum(size), []
        i = 0
        while i < len(at):  # a bounded number of pairs at a time
            j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + PAIRS, "right")))
            which, nth = tk.expand(size[i:j])
            pos, pat = at[i:j][which], self.order[lo[i:j][which] + nth]
            for w in range(m):  # words by hash, first to last
                same = h[pos + w] == self.h[pat, w]
                pos, pat = pos[same], pat[same]
            for k in range(0, len(pos), PAIRS // 16):
                out.append(self._same_bytes(pos[k : k + PAIRS // 16], pat[k : k + PAIRS // 16], data, starts, lens))
            i = j
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _same_bytes(self, at, pat, data, starts, lens):
        if not len(at):
            return at, pat
        w = at[:, None] + np.arange(self.m)
        right = (lens[w] == self.lens[pat]).all(1)
        at, pat, w = at[right], pat[right], w[right]
        idx, nth = tk.expand(self.lens[pat].ravel())
        differs = data[starts[w].ravel()[idx] + nth] != self.data[self.starts[pat].ravel()[idx] + nth]
        wrong = np.zeros(len(at) * self.m, bool)
        wrong[idx[differs]] = True
        right = ~wrong.reshape(-1, self.m).any(1)
        return at[right], pat[right]


def searchers(items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """One searcher for windows of full length and one for each length of shorter items."""
    by: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = by.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if item is not None and item not in owners:
                owners.append(item)
    return [WuManber(p, m) for m, p in sorted(by.items())]


def _scan(batch: pa.RecordBatch, text_col: str, found: list[WuManber]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Word offsets of the rows, the hit words, and for rows with occurrences their items."""
    raw, off = tk.text_bytes(batch.column(batch.schema.get_field_index(text_col)))
    data = tk.LOWER[raw]
    starts, ends, woff = tk.spans(data, off, tk.ALNUM)
    h = tk.span_hashes(data, starts, ends)
    diff = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for s in found:
        at, pat = s.search(h, woff, data, starts, ends - starts)
        np.add.at(diff, at, 1)
        np.add.at(diff, at + s.m, -1)
        rows = np.searchsorted(woff, at, "right") - 1
        for r, k in set(zip(rows.tolist(), pat.tolist(), strict=True)):
            items.setdefault(r, set()).update(s.items[k])
    return woff, np.cumsum(diff[:-1]) > 0, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, per_cent: int = 5, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated, named with ``prefix``.

    Benchmark items are read in blocks of about ``block_bytes`` of text; one block at a
    time is broadcast, and between blocks the state is written to the shared folder.  Null texts have
    no words; items of fewer words than ``window`` are one window; equal windows of
    several items count for each; an empty benchmark contaminates nothing; repeated
    rows are judged each by itself; an item without an id hits words, but is neither counted nor named.  Columns of ``docs``
    stay; those with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    added = [prefix + c for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    hits_col, items_col = (f"_weft_{c}_{prefix}" for c in ("hits", "items"))
    docs = docs.drop(*added)
    blocks = max(1, -(-text_size(benchmark, item_text_col) // block_bytes))
    df = docs.withColumns({hits_col: F.lit(None).cast("binary"), items_col: F.lit(None).cast("array<string>")})
    schema = df.schema
    for k in range(blocks):
        own = benchmark if blocks == 1 else benchmark.filter(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == k)
        rows = [(None if r[0] is None else str(r[0]), r[1]) for r in own.select(item_col, item_text_col).filter(F.col(item_text_col).isNotNull()).toLocalIterator()]
        sent = spark.sparkContext.broadcast(searchers(rows, window))

        def step(batch, sent=sent):
            woff, hit, items = _scan(batch, text_col, sent.value)
            old_hits, old_items = batch.column(batch.schema.get_field_index(hits_col)), batch.column(batch.schema.get_field_index(items_col))
            hits, ids = [], []
            for r in range(batch.num_rows):
                own_hits = hit[woff[r] : woff[r + 1]] if r in items else None
                got, before = items.get(r, set()), old_items[r].as_py() or ()
                old = old_hits[r].as_py()
                if old:
                    prev = np.unpackbits(np.frombuffer(old, np.uint8))[: woff[r + 1] - woff[r]].astype(bool)
                    own_hits = prev if own_hits is None else own_hits | prev
                hits.append(None if own_hits is None else np.packbits(own_hits).tobytes())
                ids.append(sorted(got.union(before)) or None)
            return woff, hits, ids

        if k < blocks - 1:

            def run(batches, step=step):
                for batch in batches:
                    for part in tk.sub_batches(batch, text_col, SEARCH_BYTES) if batch.num_rows else ():
                        _, hits, ids = step(part)
                        cols = dict(zip(part.schema.names, part.columns, strict=True)) | {hits_col: pa.array(hits, pa.binary()), items_col: pa.array(ids, pa.list_(pa.string()))}
                        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

            before, df = df, stored(df.mapInArrow(tk.handing_back(run), schema), "hits")
            if k:
                discard(before)

    def last(batch):
        woff, hits, ids = step(batch)
        n = np.diff(woff)
        n_hit = np.array([0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in hits], np.int64)
        values = (
            pa.array(n, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x or ()) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else EMPTY_SHA for x in ids], pa.string()),
            pa.array((n_hit > 0) & (100 * n_hit >= per_cent * n)),
        )
        return dict(zip(added, values, strict=True))

    out = with_fields(df, *zip(added, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()), strict=True))
    return df.mapInArrow(tk.appending(last, text_col, SEARCH_BYTES), out).drop(hits_col, items_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT r, i, m, item FROM win JOIN pat USING (m, p)),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS j FROM (SELECT DISTINCT r, i, m FROM occ)) GROUP BY r),
ids AS (SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
