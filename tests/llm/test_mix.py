import math
from collections import Counter

import pytest

from weftgraph.llm import mix


def weights(t, a):
    raw = [(x / sum(t)) ** a if x else 0.0 for x in t]
    return [x / sum(raw) for x in raw]


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def exponent(t, target, repeats):
    real = [x for x in t if x]
    return mix.exponent(mix.sums_of(Counter(real)), min(real) / sum(real), 1.0, target, repeats)


def test_exponent_meets_targets():
    t = [1000, 100, 10]
    a = exponent(t, 1.0, None)
    assert abs(entropy(weights(t, a)) - 1.0) < 1e-6
    b = exponent(t, None, 3.0)
    over = max(w * sum(t) / x for w, x in zip(weights(t, b), t, strict=True))
    assert over == pytest.approx(3.0, rel=1e-6) or b == 0
    assert exponent(t, 1.0, 3.0) == max(a, b)
    assert exponent(t, 99.0, None) == pytest.approx(0, abs=1e-9)
    assert exponent(t, 0.0, None) == 1.0


@pytest.mark.parametrize("t", [[1000, 100], [7, 7, 7], [5, 900, 900, 1], [1000, 900]])
def test_exponent_like_a_fine_scan(t):
    share = 0.97 * math.log(len(t))
    want = max((i / 20000 for i in range(20001) if entropy(weights(t, i / 20000)) >= share - 1e-12), default=0.0)
    assert exponent(t, share, None) == pytest.approx(want, abs=1e-4)


def test_sums_on_executors(spark):
    t = [5, 5, 17, 900, 3]
    rows = spark.createDataFrame(list(Counter(t).items()), "t long, n long")
    for x, y in zip(mix.sums_of(Counter(t))([0.0, 0.3, 1.0]), mix.sums_by(rows, sum(t))([0.0, 0.3, 1.0]), strict=True):
        assert x == pytest.approx(y)


def brute(rows, share, repeats, budget=None):
    """Weight, whole passes and rest of each source, from a scan of exponents."""
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len((t or "").split())
    live = {s: n for s, n in tokens.items() if n}
    names, t = list(live), list(live.values())
    budget = sum(t) if budget is None else budget
    grid = [i / 5000 for i in range(5001)]
    a = max((x for x in grid if entropy(weights(t, x)) >= share * math.log(len(t)) - 1e-12), default=0.0)
    ok = [x for x in grid if max(w * budget / n for w, n in zip(weights(t, x), t, strict=True)) <= repeats + 1e-12]
    return dict(zip(names, weights(t, max(a, min(ok, default=1.0))), strict=True)), live


@pytest.mark.parametrize("counts", [[0, 1000, 100], [0, 0, 0, 1000, 900], [3, 50, 700]])
def test_weights_and_passes_like_brute_force(spark, docs, counts):
    rows = [(100 * i + k, "w " * (n // 10 + (k < n % 10)), "en", f"s{i}") for i, n in enumerate(counts) for k in range(10)]
    want, live = brute(rows, 0.97, 4.0)
    out = mix.mix_documents(docs(*rows)).collect()
    got = {r["source"]: r["mix_weight"] for r in out}
    assert set(got) <= set(want) and {r["source"] for r in out} <= set(live)
    for s, w in got.items():
        assert w == pytest.approx(want[s], abs=1e-3)
        used = sum(len((r["text"] or "").split()) for r in out if r["source"] == s)
        longest = max(len((t or "").split()) for _, t, _, x in rows if x == s)
        assert w * sum(live.values()) - longest - 1 <= used <= w * sum(live.values()) + 1e-6


def test_part_pass_ends_alike_when_cells_are_narrowed(spark, docs, monkeypatch):
    rows = [(i, f"{i} " * (i % 5), "en", "big" if i % 20 else "small") for i in range(600)] + [(None, f"null {i}", "en", "big") for i in range(300)]
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("doc_id", "text", "mix_pass", "mix_place", "mix_nth").collect())
    whole = key(mix.mix_documents(docs(*rows)))
    monkeypatch.setattr(mix, "FEW", 0)
    monkeypatch.setattr(mix, "BLOCKS", 1024)
    assert key(mix.mix_documents(docs(*rows))) == whole


def rows_of(n=400):
    return [(i, "w " * (i % 9), "en", "big" if i % 10 else "small") for i in range(n)] + [(9000, None, None, None), (9001, "", "en", "big"), (9002, "only one", "en", None)]


def test_budgets_are_kept(spark, docs):
    rows = rows_of()
    words = {d: len((t or "").split()) for d, t, *_ in rows}
    out = mix.mix(docs(*rows), max_repeats=4.0).collect()
    tokens = Counter()
    for d, t, _, s in rows:
        tokens[s] += words[d]
    total = sum(tokens.values())
    used, count = Counter(), Counter((r["doc_id"], r["mix_pass"]) for r in out)
    assert max(count.values()) == 1
    for r in out:
        used[r["source"]] += words[r["doc_id"]]
    for s, t in tokens.items():
        weight = next(r["mix_weight"] for r in out if r["source"] == s)
        assert weight * total / t <= 4.0 + 1e-6
        assert weight * total - 9 <= used[s] <= weight * total + 1e-6  # a text of 8 words may not fit
    full = {s: int(weight * total) // t for s, t in tokens.items() for weight in [next(r["mix_weight"] for r in out if r["source"] == s)]}
    for d, _, _, s in rows:
        assert all(count[(d, e)] for e in range(full[s]))
    assert out == sorted(out, key=lambda r: 0) and {"score", "_items", "n_words"} <= set(out[0].asDict())


def test_natural_shares_change_nothing(spark, docs):
    rows = rows_of()
    out = mix.mix(docs(*rows), target_entropy=0.0).collect()
    with_words = sorted(d for d, t, *_ in rows if (t or "").split())
    assert sorted(r["doc_id"] for r in out if (r["text"] or "").split()) == with_words


def test_empty_tables_and_repeated_rows(spark, docs):
    assert mix.mix(docs(*rows_of()).limit(0), max_repeats=2.0).count() == 0
    assert mix.mix(docs((1, None), (2, "")), max_repeats=2.0).count() == 0
    assert mix.mix_documents(docs((1, "a b"), (1, "a b"), (2, "c"))).count() == 3


def test_order_is_a_permutation_of_blocks(spark, docs):
    out = mix.mix(docs(*[(i, "w", "en", "s") for i in range(3000)]), budget=6000, max_repeats=None, target_entropy=0.0).collect()
    first, second = ({r["mix_block"]: r["mix_place"] for r in out if r["mix_pass"] == e} for e in (0, 1))
    assert len(out) == 6000 and first.keys() == second.keys()
    order = lambda x: sorted(x, key=x.get)
    assert order(first) != order(second) and len(set(first.values())) == len(first)
    assert math.isclose(sum(1 for r in out if r["mix_pass"] == 0), 3000)
