import zlib
from collections import Counter, defaultdict

from weftgraph.llm import shard


def check(rows, out, most=None):
    assert Counter(d for d, *_ in rows) == Counter(r["doc_id"] for r in out)
    by, size = defaultdict(list), Counter()
    text = {d: t for d, t, *_ in rows}
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        by[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    if most is not None:
        assert max(size.values()) - min(size.values()) <= most
    return size


def test_balance_with_hot_groups(spark, docs):
    rows = [(i, "x" * (i * 7 % 90), "en" if i % 3 else None, f"s{i % 5}" if i % 4 else None) for i in range(2000)]
    rows += [(5000 + i, "copy of a text", "en", "s0") for i in range(1500)]
    size = check(rows, shard.shard_documents(docs(*rows)).collect(), most=400)
    assert set(size) == set(range(40))


def test_nulls_empty_long_and_repeated(spark, docs):
    rows = [(1, None, None, None), (2, "", "de", "a"), (3, "y" * 100000, "fr", "b"), (4, "z", "en", "a"), (4, "z", "en", "a"), (None, "q", None, None)]
    check(rows, shard.shard_documents(docs(*rows)).collect())
    assert shard.shard_documents(docs(*rows).limit(0)).count() == 0


def test_equal_rows_without_ids_are_spread(spark, docs):
    rows = [(None, "the same text", "en", "s")] * 400
    out = shard.shard_documents(docs(*rows)).collect()
    count = Counter(r["shard"] for r in out)
    assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))


def brute(points, shards, first=0):
    """Shards of points (key of each dimension, size, name): the widest dimension is cut where the left side is full."""
    if shards == 1:
        return {name: first for *_, name in points}
    dims = len(points[0][0])
    width = [max(p[0][d][0] for p in points) - min(p[0][d][0] for p in points) for d in range(dims)]
    d = max(range(dims), key=lambda i: (width[i], -i))
    points = sorted(points, key=lambda p: p[0][d])
    want, acc, cut = sum(p[1] for p in points) * (shards // 2) // shards, 0, len(points)
    for i, p in enumerate(points):
        if acc + p[1] > want:
            cut = i if want - acc <= acc + p[1] - want else i + 1
            break
        acc += p[1]
    return brute(points[:cut], shards // 2, first) | brute(points[cut:], shards - shards // 2, first + shards // 2)


def test_tree_like_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(i, f"{i} " + "x" * r.randrange(60), r.randrange(1000), r.choice([1.0, 2.0, 50.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, u long, v double")
    dims = [F.col("u"), F.col("v")]
    got = {x["doc_id"]: x["shard"] for x in shard.kd_shards(df, 8, dims, F.octet_length("text") + 16, tolerance=0.0).collect()}
    h = {x[0]: (x[1], x[2]) for x in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 64 - shard.TEXT_BITS), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << shard.ID_BITS))).collect()}
    ends = [(min(x[c] for x in rows), max(x[c] for x in rows)) for c in (2, 3)]
    scale = lambda x, lo, hi: int((x - lo) / (hi - lo) * 65535)
    points = [(tuple((scale(x[2 + d], *ends[d]), *h[x[0]]) for d in range(2)), len(x[1]) + 16, x[0]) for x in rows]
    assert got == brute(points, 8)
