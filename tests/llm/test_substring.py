import hashlib
import random
import re

from weftgraph.llm import substring as S


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute(rows, k):
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            owner[g] = min(owner.get(g, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if owner[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def texts(seed):
    r = random.Random(seed)
    vocab = [f"é{i}" if i % 9 == 0 else f"W{i}" for i in range(60)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    hot = say(25)
    out = []
    for _ in range(60):
        w = say(r.randint(0, 70))
        if r.random() < 0.6:
            a = r.randrange(13)
            p = list(hot[a : a + r.randint(5, 25)])
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            i = r.randint(0, len(w))
            w[i:i] = p
        if out and r.random() < 0.3:
            w += words(r.choice(out))
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return out + [None, "", "Der " * 500, "Der " * 40, out[3], "w " * 12, "long " + "b c " * 20000]


def test_like_brute_force(spark, docs):
    for seed in (1, 2):
        rows = list(enumerate(texts(seed)))
        random.Random(seed).shuffle(rows)
        rows.append(rows[4])  # a repeated row
        assert run(S.substring_dedup(docs(*rows))) == brute(rows, 13)


def test_null_ids_text_and_empty_table(spark, docs):
    t = " ".join(f"w{i}" for i in range(20))
    got = {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in S.substring_dedup(docs((None, t), (5, t), (6, "x " + t)), keep_text=True).collect()}
    assert got == {(None, 0, t), (5, 0, t), (6, 20, "x")}
    assert S.substring_dedup(docs((1, t)).limit(0)).count() == 0


def test_automaton_owners():
    r = random.Random(3)
    seqs = [([r.randrange(3) for _ in range(r.randint(1, 40))], o) for o in range(12)]
    sam = S.SuffixAutomaton()
    for s, o in seqs:
        sam.add(s, o)
    sam.finish()
    for probe, _ in [*seqs, ([r.randrange(4) for _ in range(60)], None)]:
        want = []
        for i in range(4, len(probe)):
            own = [o for s, o in seqs if any(s[j : j + 5] == probe[i - 4 : i + 1] for j in range(len(s) - 4))]
            want.append(min(own, default=None))
        assert sam.least_owners(probe, 5) == want


def test_hot_keys_go_by_windows(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)  # every shared key
    rows = list(enumerate(texts(5)))
    assert run(S.substring_dedup(docs(*rows))) == brute(rows, 13)


def test_shards_of_whole_keys(monkeypatch):
    """However the keys are cut into automata, the owners are the same."""
    import numpy as np

    r = random.Random(9)
    key = np.sort(np.array([r.randrange(12) for _ in range(60)], np.uint64))
    body = [[r.randrange(3) for _ in range(r.randint(5, 30))] for _ in key]
    size = np.array([len(x) for x in body])
    args = (key, np.arange(60, dtype=np.uint64), np.zeros(60, np.uint64), np.array([r.randrange(20) for _ in key]), size, np.array([int(k) * 10 + w for k, x in zip(key, body) for w in x], np.uint64), 5)
    want = S.judge_shard(*args)
    for words_ in (1, 40, 200):
        monkeypatch.setattr(S, "SHARD_WORDS", words_)
        least, flags = S.judge_shard(*args)
        assert (least == want[0]).all() and [None if f is None else f.tolist() for f in flags] == [None if f is None else f.tolist() for f in want[1]]
