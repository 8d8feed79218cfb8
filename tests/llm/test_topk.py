import math
import random

from weftgraph.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def run(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, -t) for n, (t, i) in enumerate(s)]
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def search(df, k=20):
    return topk.top_k(df, df.filter("vec_id % 20 = 0"), k)


def test_like_brute_force(spark):
    r = random.Random(1)
    import numpy as np

    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(r.gauss(0, 0.2) for _ in range(8)), 0) for i in range(300)]
    hot = f32([0.5] * 8)
    rows += [(1000 + i, hot, 1) for i in range(120)]  # ties
    rows += [(2000, None, 0), (2020, [None] + [0.1] * 7, 0), (2040, [float("inf")] * 8, 0), (2060, [float("nan")] * 8, 0), (2080, [], 0), (2100, f32([0.5] * 5), 0), (None, hot, 0)]
    assert run(search(make(spark, rows))) == brute(rows, 20)


def test_few_candidates_and_empty_table(spark):
    rows = [(0, [0.1, 0.2], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)]
    assert run(search(make(spark, rows))) == brute(rows, 20)
    assert run(search(make(spark, rows).limit(0))) == []


def test_tiles_and_compaction():
    import numpy as np

    rng = np.random.default_rng(4)
    c = np.floor(64 * rng.normal(size=(9000, 64)) * np.linspace(0.5, 0.01, 64))
    ids = rng.permutation(9000)
    at, score, got = topk.search_cell(ids[:300], c[:300], ids, c, 5)
    full = (c[:300] @ c.T).astype(int)
    for i in range(300):
        want = sorted((-s, d) for s, d in zip(full[i].tolist(), ids.tolist(), strict=True) if d != ids[i])[:5]
        assert sorted(zip((-score[at == i]).tolist(), got[at == i].tolist(), strict=True)) == want
