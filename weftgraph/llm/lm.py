"""Language-model scoring with a sharded Elias-Fano bigram trie.

Every chunk of documents sends its distinct words and bigrams, with their counts in training
texts, to buckets.  A bucket of words sums the counts.  A bucket of bigrams builds a trie shard
(monotone pointers, successors by context, quantised probabilities) in a memory map and looks up each
chunk's bigrams in it by context-relative successor search.  The chunk then
scores its texts.  The model is never in one place, so it may grow with the
corpus; a context is spread over several shards, so a frequent word is no hot spot.

Smoothing is Dirichlet's: p(w | v) = (c(v, w) + m p(w)) / (c(v) + m), with the base distribution
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).  A shard has a part of the successors of v, which come n times in all; it stores the
quantised c(v, w) / n, and the asking chunk, which knows c(v) and p(w), weights it with n / (c(v) + m) and adds m / (c(v) + m) p(w).
The parts' n add up to c(v), so over all words p(. | v) sums to 1 within the error of a code, 2 ** (0.5 / STEPS), and never
exceeds 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import crc_mod, table
from .eliasfano import BigramTrie, dequantise, quantise
from .exchange import blob, bucket_slices, chunk_words, chunked, column, in_order

#: Hashes of the end token and of the context at the start of a text.
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A2700000000003)
#: Parts of a context's successors that go to different shards.
SPREAD_BITS = 3
PRIOR = 4.0
#: Text bytes of a chunk; a task holds about fifteen times as much.
CHUNK_BYTES = 12 << 20


def _tokens(t: pa.Table):
    """Distinct token hashes (with START), and for each token position its index, the index of
    its context, and the row offsets."""
    h, woff = chunk_words(t, tk.LOWER)
    n = np.diff(woff)
    off = woff + np.arange(len(woff))
    tok = np.empty(len(h) + len(n), np.uint64)
    tok[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    tok[off[1:] - 1] = END
    keys, idx = np.unique(np.append(tok, START), return_inverse=True)
    start = idx[-1]
    idx = idx[:-1]
    ctx = np.empty(len(idx), np.int64)
    ctx[1:] = idx[:-1]
    ctx[off[:-1]] = start
    return keys, idx.astype(np.int64), ctx, off, int(start)


def _pairs(keys: np.ndarray, idx: np.ndarray, ctx: np.ndarray, buckets: int):
    """Distinct bigrams by bucket: index of each position's bigram, context and successor
    indices of the bigrams, and bucket offsets."""
    code, inverse = np.unique(ctx * len(keys) + idx, return_inverse=True)
    c, s = code // len(keys), code % len(keys)
    part = keys[s] >> np.uint64(64 - SPREAD_BITS)
    bucket = (tk.mix(keys[c] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[inverse], c[order], s[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack40(x: np.ndarray) -> bytes:
    """The upper 40 bits of each hash."""
    return blob((x >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _planes(x: np.ndarray, kind: str) -> bytes:
    """The lowest bytes of all numbers first, the highest last, which are nearly all 0 and compress away."""
    x = np.ascontiguousarray(x.astype(kind))
    return blob(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_codes(code: np.ndarray, total: np.ndarray, runs: np.ndarray) -> bytes:
    """Codes as steps above that of a single occurrence in the context, so most are 1; 0 stays 0."""
    one = np.repeat(quantise(1 / np.maximum(total, 1)).astype(np.int64), runs)
    return _planes(np.where(code > 0, 1 + one - code, 0), "<u2")


def _unpack_codes(raw: bytes, total: np.ndarray, runs: np.ndarray) -> np.ndarray:
    steps = _from_planes(raw, "<u2").astype(np.int64)
    one = np.repeat(quantise(1 / np.maximum(total, 1)).astype(np.int64), runs)
    return np.where(steps > 0, 1 + one - steps, 0).astype(np.uint16)


def build_shard(context: list[np.ndarray], successor: list[np.ndarray], count: list[np.ndarray]) -> BigramTrie:
    """A trie of the summed counts of several chunks; bigrams without training count are left out."""
    c, s, n = (np.concatenate(x) for x in (context, successor, count))
    live = n > 0
    c, s, n = c[live], s[live], n[live]
    order = np.lexsort((s, c))
    c, s, n = c[order], s[order], n[order]
    if not len(c):
        return BigramTrie.build(c, s, n)
    first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])))
    return BigramTrie.build(c[first], s[first], np.add.reduceat(n, first))


def score_texts(docs: DataFrame, is_training, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score for the id of each row.

    ``is_training`` is a boolean column of ``docs`` (null: not).  Tokens are words (lower-cased
    A-Z, split at ASCII white space) and one end token; null texts count as
    empty and have only the end.  Repeated rows count as often as they come.  Without
    training texts all counts are 0 and N is 0.
    """
    base, buckets = chunked(docs, id_col, text_col, CHUNK_BYTES, extra={"train": F.coalesce(is_training, F.lit(False))})
    by_chunk = lambda df: df.groupBy("chunk")
    fields = [("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
    message = "bucket int, chunk int, kind int, a binary, b binary, c binary, d binary"

    def send(t: pa.Table) -> pa.Table:
        t = in_order(t)
        train = np.asarray(t.column("train").to_numpy(zero_copy_only=False), bool)
        keys, idx, ctx, off, start = _tokens(t)
        in_train = np.repeat(train, np.diff(off))
        count = np.bincount(idx[in_train], minlength=len(keys))
        count[start] = int(train.sum())
        chunk = t.column("chunk")[0].as_py()
        rows = []
        cut = bucket_slices(keys, buckets)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            rows.append((b, chunk, 0, blob(keys[cut[b] : cut[b + 1]]), blob(count[cut[b] : cut[b + 1]]), b"", b""))
        at, c, s, cut = _pairs(keys, idx, ctx, buckets)
        pairs = np.bincount(at[in_train], minlength=len(c)).astype(np.uint32)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = cut[b], cut[b + 1]
            new = np.flatnonzero(np.append(True, c[lo:hi][1:] != c[lo:hi][:-1]))
            rows.append((b, chunk, 1, blob(keys[c[lo:hi][new]]), blob(np.diff(np.append(new, hi - lo)).astype(np.uint32)), _pack40(keys[s[lo:hi]]), blob(pairs[lo:hi])))
        return pa.table([list(x) for x in zip(*rows, strict=True)], schema=pa.schema(fields))

    sent = by_chunk(base).applyInArrow(send, message).repartition(buckets, "bucket")

    def merged(t: pa.Table):
        keys, count = column(t, "a", np.uint64), column(t, "b", np.int64)
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return every, np.bincount(inverse, weights=np.concatenate(count), minlength=len(every)).astype(np.int64), inverse, [len(k) for k in keys]

    def answer(t: pa.Table) -> pa.Table:
        kind, out, parts = t.column("kind")[0].as_py(), [], []
        if kind == 0:
            _, total, inverse, sizes = merged(t)
            out = [blob(x) for x in np.split(total[inverse], np.cumsum(sizes)[:-1])]
        else:
            ctx, runs = column(t, "a", np.uint64), [x.astype(np.int64) for x in column(t, "b", np.uint32)]
            suc = [_unpack40(x) for x in t.column("c").to_pylist()]
            shard = build_shard([np.repeat(k, r) for k, r in zip(ctx, runs, strict=True)], suc, [x.astype(np.int64) for x in column(t, "d", np.uint32)])
            shard = shard.mapped()
            for c, r, x in zip(ctx, runs, suc, strict=True):
                part, code = shard.lookup(c, r, x)
                out.append(_pack_codes(code, part, r))
                parts.append(_planes(part, "<i8"))
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "kind": t.column("kind"), "a": tk.binary_array(out), "b": tk.binary_array(parts or [b""] * len(out))})

    answers = sent.groupBy("kind", "bucket").applyInArrow(answer, "chunk int, bucket int, kind int, a binary, b binary")

    def total(t: pa.Table) -> pa.Table:
        n = v = 0
        if t.column("kind")[0].as_py() == 0:
            every, count, _, _ = merged(t)
            real = every != START
            n, v = int(count[real].sum()), int((count[real] > 0).sum())
        return pa.table({"n": pa.array([n], pa.int64()), "v": pa.array([v], pa.int64())})

    # the same exchange once more, of which only messages of words go on
    of_words = lambda c: F.when(F.col("kind") == 0, F.col(c)).alias(c)
    words = sent.select("bucket", "kind", "chunk", of_words("a"), of_words("b"), F.octet_length("c").alias("c"), F.octet_length("d").alias("d"))
    totals = words.groupBy("kind", "bucket").applyInArrow(total, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    # one small row for each chunk
    packed = F.unhex(F.concat(F.lpad(F.hex("n"), 16, "0"), F.lpad(F.hex("v"), 16, "0")))
    told = totals.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("chunk"), F.lit(-1).alias("bucket"), F.lit(2).alias("kind"), packed.alias("a"), F.lit(b"").alias("b"))

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not t.num_rows:
            return schema.empty_table()
        t = in_order(t)
        keys, idx, ctx, off, _ = _tokens(t)
        at, c, s, cut2 = _pairs(keys, idx, ctx, buckets)
        cut1 = bucket_slices(keys, buckets)
        count, code, part = np.zeros(len(keys), np.int64), np.zeros(len(c), np.uint16), np.zeros(len(c), np.int64)
        n = v = 0
        for b, kind, raw, sums in zip(*(got.column(x).to_pylist() for x in ("bucket", "kind", "a", "b")), strict=True):
            if kind == 0:
                count[cut1[b] : cut1[b + 1]] = np.frombuffer(raw, np.int64)
            elif kind == 1:
                lo, hi = cut2[b], cut2[b + 1]
                total = _from_planes(sums, "<i8")
                runs = np.diff(np.concatenate([[lo], lo + 1 + np.flatnonzero(c[lo + 1 : hi] != c[lo : hi - 1]), [hi]]))
                code[lo:hi] = _unpack_codes(raw, total, runs)
                part[lo:hi] = np.repeat(total, runs)
            else:
                n, v = (int(x) for x in np.frombuffer(raw, ">i8"))
        unigram = (count + 0.5) / (n + 0.5 * (v + 1))
        p = unigram[idx]
        model = ((dequantise(code) * part)[at] + prior * p) / (count[ctx] + prior)
        sums = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every row has its end token
        out = {"id": t.column("id"), "n_tokens": pa.array(np.diff(off), pa.int64()), "n_known": pa.array(sums((count[idx] > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(t.num_rows, n), pa.int64()), "base_score": pa.array(sums(np.log10(p))), "score": pa.array(sums(np.log10(model)))}
        return pa.table(out, schema=schema)

    done = by_chunk(base).cogroup(by_chunk(answers.unionByName(told))).applyInArrow(score, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    out = score_texts(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
