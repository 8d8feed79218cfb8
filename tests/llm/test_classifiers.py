import random

from weftgraph.llm import langid, quality

SYL = {"en": "th er on an re he in ed nd ha at en es of or nt".split(), "de": "sch ein ung keit ver ge lich ö ü ß pf tz".split(), "fr": "eau ou ez é è ç tion ent qu oi aux".split(), "es": "ción ñ ll rr ado que os as mente í".split()}


def say(r, lang, n):
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed, n=240):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(list(SYL))
        text, good = say(r, lang, r.randint(8, 60)), i % 3 > 0
        if not good:
            text = r.choice([lambda t: t.upper() + "!!", lambda t: " ".join(w + "***" for w in t.split()), lambda t: "Der " * 50])(text)
        rows.append((i, text, lang, "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_votes(spark, docs):
    rows, labels = corpus(1)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (77777, 0, 0), (3, 2, 0)], "doc_id long, quality int, toxic int")
    extra = [(900, None), (901, ""), (902, " "), (903, "x" * 200000), (1, rows[1][1])]
    d = docs(*rows, *extra)
    out = quality.classify(d, quality.model_of(d, lab)).select("doc_id", "score", "predicted").collect()
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in out if r["doc_id"] in truth and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out) and len(out) == len(rows) + 5
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert quality.classify(d.limit(0), None).count() == 0
    assert quality.model_of(d, lab.limit(0)) is None
    assert {r["score"] for r in quality.classify(d, None).collect()} == {0.5}
    kept = quality.classify(d, None, prefix="_p_").first()
    assert kept["score"] == "extra" and kept["_p_score"] == 0.5


def test_exact_cosine_voting():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (60, (1 << quality.BITS) + quality.STYLE)).astype(np.float32)
    y = rng.integers(0, 2, 60)
    m = quality.LatentVoting(x, y, 0.5, 16, 7)
    v = m._unit(m._weigh(x[:9]) @ m.project)
    for i in range(9):
        sim = m.points @ v[i]
        near = np.argsort(-sim)[:7]
        w = np.maximum(sim[near], 0) ** 8 * m.weight[near]
        assert abs(m.score(x[i : i + 1])[0] - (w * y[near]).sum() / w.sum()) < 1e-4


def test_languages(spark, docs):
    rows, _ = corpus(2)
    rows = [(i, say(random.Random(i), lang, 25), lang, s) for i, _, lang, s in rows]
    extra = [(900, None, "en"), (901, "", "en"), (902, "123 --- !?", "en"), (903, "日本語 の 文", None), (904, "x" * 200000, None)]
    d = docs(*rows, *extra)
    out = {r["doc_id"]: r for r in langid.identify(d.select("doc_id", "text"), langid.fit(d.filter("doc_id % 4 <> 2"))).collect()}
    truth = {i: lang for i, _, lang, _ in rows}
    held = [i for i in truth if i % 4 == 2]
    assert sum(out[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert out[903]["lang_pred"] in SYL and all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.fit(d.limit(0)) is None and langid.identify(d.limit(0), None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d, None).collect()} == {"und"}


def test_one_language_only(spark, docs):
    d = docs(*[(i, say(random.Random(i), "en", 9), "xx") for i in range(20)])
    assert {r["lang_pred"] for r in langid.identify(d, langid.fit(d)).collect()} == {"xx"}


def test_tied_neighbours():
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(0, 5, (6, (1 << quality.BITS) + quality.STYLE)), 10, axis=0).astype(np.float32)
    y = rng.integers(0, 2, 60)
    m = quality.LatentVoting(x, y, 0.5, 5, 4)
    for i in range(0, 60, 10):  # ten equal vectors: the first four vote
        w = m.weight[i : i + 4]
        assert abs(m.score(x[i : i + 1])[0] - (w * y[i : i + 4]).sum() / w.sum()) < 1e-4


def test_family_then_pairs_like_brute_force():
    """The family with the largest squashed margin, then the votes of its machines, by plain loops."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    langs = ["en", "de", "fr", "es", "xx"]
    y = [langs[i % 5] for i in range(100)]
    x = rng.random((100, 12)).astype(np.float32)
    for i, k in enumerate(y):
        x[i, langs.index(k)] += 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = langid.FamilyThenLanguage(x, y)
    squash = lambda v: 1 / (1 + math.exp(-4 * min(8, max(-8, v))))
    lang, score = m.predict(x)
    assert sum(a == b for a, b in zip(lang, y, strict=True)) > 90
    for i in range(100):
        row = [*map(float, x[i]), 1.0]
        dot = lambda w: sum(a * float(b) for a, b in zip(row, w, strict=True))  # noqa: E731, B023
        fam = [squash(dot(w)) for w in m.family_w]
        f = max(range(len(fam)), key=lambda k: fam[k])
        members, votes = m.members[f], [0.0] * len(m.members[f])
        for (a, b), w in m.pair_w[f].items():
            votes[a] += squash(dot(w))
            votes[b] += 1 - squash(dot(w))
        want = fam[f] / sum(fam) * (max(votes) / max(1, len(members) - 1) if len(members) > 1 else 1)
        assert lang[i] == members[votes.index(max(votes))] and abs(score[i] - want) < 1e-4
