import hashlib
import random
import re

from weftgraph.llm import decontaminate as D

RX = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return RX.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=13):
    pats = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for p, own in pats.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def cases(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "Éa", "b2", "x", "Zeta", "und", "ß", "one", "two"]
    say = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(99, None), (98, "..."), (97, "qux quux")]
    docs = [(i, say(r.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, say(r.randint(0, 40)) + " " + (items[i][1] or "") + " " + say(3)) for i in range(12)]
    return docs + [(200, None), (201, ""), (202, "QUX  quux!"), (203, say(30000)), (203, say(5)), (100, docs[-1][1])], items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_like_brute_force(spark, docs):
    rows, items = cases(1)
    assert run(D.decontaminate(docs(*rows), bench(spark, items))) == brute(rows, items)


def test_blocks_of_the_benchmark(spark, docs):
    rows, items = cases(2)
    rows = [x for x in rows if x[0] != 203]
    assert run(D.decontaminate(docs(*rows), bench(spark, items), block_bytes=100)) == brute(rows, items)


def test_empty_tables_and_kept_columns(spark, docs):
    rows, items = cases(3)
    out = D.decontaminate(docs(*rows), bench(spark, items).limit(0), prefix="_p_")
    assert out.filter("_p_contaminated OR _p_n_hit > 0").count() == 0
    assert out.filter("n_words = 9 AND _items = 7").count() == len(rows)
    assert run(D.decontaminate(docs(*rows).limit(0), bench(spark, items))) == []


def test_items_without_id_and_columns_that_stay(spark, docs):
    bench = spark.createDataFrame([(None, "a b c d"), (7, "c d e f")], "item_id long, text string")
    d = docs((1, "x a b c d y"), (2, "a b c d e f"), (3, "none here")).withColumnRenamed("score", "_hits")
    out = {r["doc_id"]: r for r in D.decontaminate(d, bench, block_bytes=4).collect()}
    assert [(out[i]["n_hit"], out[i]["n_items"], out[i]["contaminated"]) for i in (1, 2, 3)] == [(4, 0, True), (6, 1, True), (0, 0, False)]
    assert out[1]["_hits"] == "extra" and out[1]["_items"] == 7


def test_tables_grow_with_the_patterns():
    import random

    r = random.Random(1)
    items = [(str(i), " ".join(f"w{r.randrange(50_000)}" for _ in range(300))) for i in range(100)]
    (s,) = D.searchers(items, 13)
    assert (s.shift == 0).mean() < 0.1 and s.shift.mean() > 8
