import random
import re

import pytest

from weftgraph.llm import neardup as N


def shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def run(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def group(r, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_like_brute_force(spark, docs, k):
    r = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 80))) for _ in range(60)]
    for n, copies, edits in ((90, 60, 12), (40, 20, 3), (12, 10, 1), (300, 15, 20)):
        texts += group(r, [r.choice(vocab) for _ in range(n)], copies, edits)
    # one passage in many texts, short texts, equal texts in other spacing and case
    hot = " ".join(r.choice(vocab) for _ in range(30))
    texts += [hot + " " + " ".join(r.choice(vocab) for _ in range(45)) for _ in range(40)]
    texts += [None, "", "  \n", "One", "one", "one two", "One\ttwo", "one two three", texts[5], texts[5].upper(), "x " * 20000]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(N.near_duplicates(docs(*rows), words=k)) == brute(rows, k)


def test_repeated_rows_and_empty_table(spark, docs):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e F"), (2, None), (2, None)]
    assert run(N.near_duplicates(docs(*rows), words=2)) == [(1, 5, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 5, 1, False), (3, 5, 1, False)]
    assert run(N.near_duplicates(docs(*rows).limit(0))) == []


def test_signature_estimates_similarity():
    import numpy as np
    import pyarrow as pa

    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in range(30, 330))
    bands = np.array(N._signatures(pa.array([a, a, b]), 2)["_bands"].to_pylist())
    assert (bands[0] == bands[1]).all() and 0 < (bands[0] == bands[2]).mean() < 1


def test_null_ids_and_two_texts_under_one_id(spark, docs):
    a, b, c = ("a b c d e f", "p q r s t u", "x y z v w k")
    rows = [(None, a), (7, a), (9, b), (9, c), (None, c), (None, "lone text of six words here"), (None, None), (4, b)]
    got = N.near_duplicates(docs(*rows), words=2).select("doc_id", "component_id", "kept").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, [(None, 7, False), (7, 7, True), (9, 4, False), (9, 9, True), (None, 9, False), (None, None, True), (None, None, True), (4, 4, True)]))
    kept = N.keep_one(docs(*rows), words=2).select("doc_id", "text").collect()
    assert sorted(map(key, kept)) == sorted(map(key, [(7, a), (4, b), (9, c), (None, rows[5][1]), (None, None)]))


def test_keep_one_of_repeated_rows(spark, docs):
    rows = [(1, "a b c d e f g")] * 5 + [(1, "a b c d e f g", "de")] + [(None, "q r s t u v w")] * 3 + [(2, "")] * 2
    got = N.keep_one(docs(*rows)).select("doc_id", "text", "lang").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == [("1", "a b c d e f g", "de"), ("2", "", "en"), ("2", "", "en"), ("None", "q r s t u v w", "en")]


def test_small_sets_are_found(spark, docs):
    """Unions of 5 to 16 elements at a similarity of 0.8 and just over, where bands are least certain."""
    rows, pairs = [], 0
    for i in range(1500):
        for extra, n in ((1, 4), (1, 8), (2, 13)):
            base = [f"{i}w{k}q{n}" for k in range(n + 1)]
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(base + [f"{i}z{k}q{n}" for k in range(extra)]))]
            pairs += 1
    got = N.near_duplicates(docs(*rows), words=2).filter("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert got == pairs


def test_unlinked_bucket_is_resolved_by_sets(spark, docs, monkeypatch):
    """Without rounds of pivots, all links come from the prefixes of the sets."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if r.random() > 0.12 else f"u{r.randrange(10**6)}" for w in base) for _ in range(40)]
    texts += group(r, base, 20, 2)
    rows = list(enumerate(texts))
    monkeypatch.setattr(N, "ROUNDS", 0)
    monkeypatch.setattr(N, "MEMBERS", 3)
    assert run(N.near_duplicates(docs(*rows), words=2)) == brute(rows, 2)


def test_parts_of_groups(spark, docs, monkeypatch):
    r = random.Random(6)
    rows = list(enumerate(group(r, [f"w{i}" for i in range(90)], 60, 14)))
    monkeypatch.setattr(N, "MEMBERS", 2)
    assert run(N.near_duplicates(docs(*rows), words=2)) == brute(rows, 2)
