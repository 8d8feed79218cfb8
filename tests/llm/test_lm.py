import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import eliasfano as E
from weftgraph.llm import lm


def test_sequences():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (700, 90), (4000, 2**63), (3000, 3000), (2, 0), (1, 2**64 - 2), (5000, 40)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        s = E.EliasFano.encode(v)
        assert (s.access(np.arange(n)) == v).all()
        x = np.append(rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, top, top + 1], np.uint64))
        assert (s.successor(x)[0] == np.searchsorted(v, x)).all()
        at = s.index_of(x)
        assert ((at >= 0) == np.isin(x, v)).all()
    assert (E.EliasFano.encode(np.zeros(0, np.uint64)).index_of(np.array([1], np.uint64)) == -1).all()


def test_trie_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    c = np.sort(np.repeat(rng.integers(0, 2**63, 30, dtype=np.uint64), 50))
    s = rng.integers(0, 2**40, len(c), dtype=np.uint64)
    order = np.lexsort((s, c))
    c, s, n = c[order], s[order], rng.integers(1, 1000, len(c))
    trie = E.BigramTrie.build(c, s, n)
    (tmp_path / "trie").write_bytes(trie.to_bytes())
    opened = E.BigramTrie.open(str(tmp_path / "trie"))  # memory-mapped
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    runs = np.diff(np.append(first, len(c)))
    for t in (trie, opened):
        total, code = t.lookup(c[first], runs, s)
        assert (total == np.add.reduceat(n, first)).all() and (code == E.quantise(n / np.repeat(total, runs))).all()
        assert not any(x.any() for x in t.lookup(c[first] ^ np.uint64(1), runs, s)) and not t.lookup(c[first], runs, s ^ np.uint64(1))[1].any()
        share = E.dequantise(code) * np.repeat(total, runs)
        assert (np.abs(np.log2(share / n)) <= 0.5 / E.STEPS + 1e-9).all()
    mapped = trie.mapped()
    assert all((x == y).all() for x, y in zip(mapped.lookup(c[first], runs, s), trie.lookup(c[first], runs, s), strict=True))
    empty = E.BigramTrie.build(c[:0], s[:0], n[:0]).mapped()
    assert not any(x.any() for x in empty.lookup(c[:1], np.array([1]), s[:1]))


def brute(rows, trained):
    toks = [(d, re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [0]) for d, t in rows]
    c, bi, starts = Counter(), Counter(), 0
    for d, w in toks:
        if d is not None and trained(d):
            c.update(w)
            bi.update(zip([1, *w[:-1]], w, strict=True))
            starts += 1
    n, v = sum(c.values()), len(c)
    out = []
    for d, w in toks:
        p = [(c[t] + 0.5) / (n + 0.5 * (v + 1)) for t in w]
        ctx = [starts if a == 1 else c[a] for a in [1, *w[:-1]]]
        m = sum(math.log10((bi[a, t] + lm.PRIOR * q) / (k + lm.PRIOR)) for a, t, q, k in zip([1, *w[:-1]], w, p, ctx, strict=True))
        out.append((d if d is not None else -1, len(w), sum(c[t] > 0 for t in w), n, sum(map(math.log10, p)), m))
    return sorted(out)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) <= 2e-4 * b[1] + 1e-6


def run(df):
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in df.collect())


def test_like_brute_force(spark, docs):
    r = random.Random(5)
    vocab = ["the", "The", "of", "É", "a1"] + [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(r.choice(vocab[: r.randint(1, 85)]) for _ in range(r.randint(0, 50)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "the " * 30000), (503, rows[3][1]), (3, rows[3][1]), (None, "the of")]
    same(run(lm.score_texts(docs(*rows), F.col("doc_id") % 5 != 1)), brute(rows, lambda d: d % 5 != 1))


def test_without_training_and_empty_table(spark, docs):
    rows = [(1, "a b"), (2, None)]
    same(run(lm.score_texts(docs(*rows), F.lit(False))), brute(rows, lambda d: False))
    assert lm.score_texts(docs(*rows).limit(0), F.lit(True)).count() == 0


def test_counts_of_large_corpora_do_not_saturate():
    p = np.array([1.0, 0.5, 1 / 3, 1 / 2_353_974, 1e-12, 2.0**-62])
    assert (np.abs(np.log2(E.dequantise(E.quantise(p)) / p)) <= 0.5 / E.STEPS + 1e-9).all()
    c, s = np.full(3, 7, np.uint64), np.arange(3, dtype=np.uint64)
    shard = lm.build_shard([c, c], [s, s], [np.array([3, 2_000_000, 20_000_000]), np.array([0, 1_500_000, 30_000_000])])
    opened = E.BigramTrie.from_buffer(shard.to_bytes())
    for t in (shard, opened):
        total, code = t.lookup(c[:1], np.array([3]), s)
        share = E.dequantise(lm._unpack_codes(lm._pack_codes(code, total, np.array([3])), total, np.array([3])))
        assert total.tolist() == [53_500_003] and np.abs(share * total / [3, 3_500_000, 50_000_000] - 1).max() < 1e-3
    none = np.zeros(0, np.int64)
    assert not len(lm._unpack_codes(lm._pack_codes(none, none, none), none, none))


def test_packed_codes_round_trip():
    rng = np.random.default_rng(11)
    runs, n = np.array([1, 5, 300]), rng.integers(1, 10**6, 306)
    total = np.add.reduceat(n, [0, 1, 6])
    code = E.quantise(n / np.repeat(total, runs))
    code[::7] = 0
    raw = lm._pack_codes(code, total, runs)
    assert (lm._unpack_codes(raw, total, runs) == code).all()
    assert (lm._from_planes(lm._planes(total, "<i8"), "<i8") == total).all()


def test_distributions_are_normalised():
    """Over all words, p(. | v) sums to 1 within the error of a code, however a context is spread; no p exceeds 1."""
    rng = np.random.default_rng(7)
    for words in (1, 2, 17, 900):
        succ, n = np.sort(rng.choice(2**40, words, replace=False)).astype(np.uint64), rng.integers(1, 50, words)
        base = np.append(n + 0.5, 0.5) / (n.sum() + 0.5 * (words + 1))  # the last one: all words that aren't known
        part, found = rng.integers(0, 8, words), np.zeros(words)
        for k in range(8):
            own = part == k
            if own.any():
                context = np.full(own.sum(), 5, np.uint64)
                total, code = lm.build_shard([context], [succ[own]], [n[own]]).mapped().lookup(context[:1], np.array([own.sum()]), succ[own])
                found[own] = E.dequantise(code) * total[0]
        p = (np.append(found, 0.0) + lm.PRIOR * base) / (n.sum() + lm.PRIOR)
        assert abs(p.sum() - 1) <= 2 ** (0.5 / E.STEPS) - 1 and p.max() <= 1


def test_no_text_is_likelier_than_certain(spark, docs):
    out = lm.score_texts(docs(*[(i, "same words again") for i in range(300)]), F.lit(True)).collect()
    assert all(-1e-1 < r["score"] <= 0 for r in out)
