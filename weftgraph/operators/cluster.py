"""Communities by modularity, as joins over edge and label tables.

Moves are synchronous: in each sweep a third of the nodes, by a hash that changes every three
sweeps, look at their neighbours' communities and take the best.  A sweep that
doesn't raise the modularity is undone, and five in a row that raise it by no more than 1e-6 end the level; then communities
become the nodes of the next level.  Ties go to the smaller label, so results repeat.
Communities that are too large, and then those of too few edges, are divided by passes of their own, all at once.

Up to ``packed.NODES`` nodes, labels are arrays on the driver that each sweep sends to the blocks of edges; larger
graphs are swept by joins.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, stored
from . import packed


def _both(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions, loops once."""
    return edges.select("u", "v", "w").union(edges.filter("u <> v").select("v", "u", "w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of weighted undirected edges (u, v, w) under (id, com); loops count twice in degrees."""
    named = edges.join(labels.select(F.col("id").alias("u"), F.col("com").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("com").alias("cv")), "v")
    inside = F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)
    one = named.agg(F.sum(inside), F.sum("w")).first()
    if not one[1]:
        return 0.0
    total = named.select(F.explode(F.array("cu", "cv")).alias("com"), "w").groupBy("com").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return one[0] / one[1] - resolution * total / (2 * one[1]) ** 2


def _qualities(edges: DataFrame, labels: DataFrame, resolution: float) -> DataFrame:
    """(g, q): modularity of each group of edges (g, u, v, w), none of which leads out of its group."""
    named = edges.join(labels.select(F.col("id").alias("u"), F.col("com").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("com").alias("cv")), "v")
    inside = named.groupBy("g").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    mass = named.select("g", F.explode(F.array("cu", "cv")).alias("com"), "w").groupBy("g", "com").agg(F.sum("w").alias("k")).groupBy("g").agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inside.join(mass, "g").select("g", (F.col("inside") / F.col("m") - resolution * F.col("squares") / (2 * F.col("m")) ** 2).alias("q"))


def _level(edges: DataFrame, resolution: float, sweeps: int | None) -> DataFrame:
    """(id, com) after local moves from singletons, each group of edges (g, u, v, w) by itself."""
    ends = edges.select("g", F.explode(F.array("u", "v")).alias("id"), "w")
    degree = ends.groupBy("g", "id").agg(F.sum("w").alias("k"))
    degree = stored(degree.join(degree.groupBy("g").agg(F.sum("k").alias("two_m")), "g"), "cluster-degree")
    both = stored(_both(edges.filter("u <> v")), "cluster-edges")
    labels = stored(degree.select("id", F.col("id").alias("com")), "cluster")
    best, idle = stored(_qualities(edges, labels, resolution), "cluster-quality"), 0
    for sweep in _turns(sweeps):
        mass = degree.join(labels, "id").groupBy("com").agg(F.sum("k").alias("mass"))
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id"), F.col("com").alias("to")).agg(F.sum("w").alias("links"))
        x = near.join(degree, "id").join(labels, "id").join(mass.withColumnRenamed("com", "to"), "to")
        rest = F.when(F.col("to") == F.col("com"), F.col("mass") - F.col("k")).otherwise(F.col("mass"))
        gain = F.round(F.col("links") - resolution * F.col("k") * rest / F.col("two_m"), 9)
        x = x.withColumn("gain", gain)
        top = x.groupBy("id").agg(F.max(F.when(F.col("to") == F.col("com"), F.col("gain"))).alias("stay"), F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("b"))
        alone = labels.join(mass, "com").join(degree, "id").select("id", F.col("g").alias("own"), F.round(-resolution * F.col("k") * (F.col("mass") - F.col("k")) / F.col("two_m"), 9).alias("without"))
        moved = labels.join(top, "id", "left").join(alone, "id", "left")
        go = _turn(sweep) & (-F.col("b.g") > F.coalesce("stay", "without"))
        new = stored(moved.select("id", "own", F.col("com").alias("old"), F.when(go, F.col("b.to")).otherwise(F.col("com")).alias("com")), "cluster")
        q = stored(_qualities(edges, new.select("id", "com"), resolution).join(best.select("g", F.col("q").alias("was")), "g").withColumn("better", F.col("q") > F.col("was") + 1e-9), "cluster-quality")
        idle = idle + 1 if q.filter(F.col("q") > F.col("was") + SETTLED).isEmpty() else 0
        best = q.select("g", F.when(F.col("better"), F.col("q")).otherwise(F.col("was")).alias("q"))
        labels = stored(new.join(q.select(F.col("g").alias("own"), "better"), "own").select("id", F.when(F.col("better"), F.col("com")).otherwise(F.col("old")).alias("com")), "cluster")
        if idle == IDLE:
            break
    return labels


def _parts_by_joins(edges: DataFrame, resolution: float, levels: int | None, sweeps: int | None) -> DataFrame:
    """(id, com), named after the smallest member, of groups of edges (g, u, v, w)."""
    total = None
    for _ in count() if levels is None else range(levels):
        found = _level(edges, resolution, sweeps)
        n, c = found.agg(F.count(F.lit(1)), F.countDistinct("com")).first()
        total = found if total is None else stored(total.join(found.select(F.col("id").alias("com"), F.col("com").alias("up")), "com").select("id", F.col("up").alias("com")), "cluster")
        if c == n:
            break
        lab = lambda s: found.select(F.col("id").alias(s), F.col("com").alias(f"c{s}"))  # noqa: E731, B023
        edges = stored(edges.join(lab("u"), "u").join(lab("v"), "v").groupBy("g", F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")), "cluster-edges")
    return stored(total.join(total.groupBy("com").agg(F.min("id").alias("first")), "com").select("id", F.col("first").alias("com")), "cluster")


def _by_joins(simple: DataFrame, resolution: float, levels: int | None, sweeps: int | None, split: bool) -> DataFrame:
    """``communities`` of a graph of any size."""
    edges = stored(simple.select(F.lit("").alias("g"), F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(1.0).alias("w")), "cluster-base")
    total = _parts_by_joins(edges, resolution, levels, sweeps)
    n = total.count()
    for many in (True, False) if split else ():
        side = lambda s: total.select(F.col("id").alias(s), F.col("com").alias(f"c{s}"))  # noqa: E731, B023
        inside = edges.join(side("u"), "u").join(side("v"), "v").filter("cu = cv").select(F.col("cu").alias("g"), "u", "v", "w")
        size = total.groupBy("com").agg(F.count(F.lit(1)).alias("size")).join(inside.groupBy(F.col("g").alias("com")).agg(F.sum("w").alias("inner")), "com", "left")
        rule = F.col("size") > max(LEAST, int(n * SHARE)) if many else (F.col("size") >= LOOSE) & (F.coalesce("inner", F.lit(0.0)) < COHESION * F.col("size") * (F.col("size") - 1) / 2)
        chosen = stored(size.filter(rule).select("com"), "cluster-split")
        if chosen.isEmpty():
            continue
        parts = _parts_by_joins(stored(inside.join(chosen.withColumnRenamed("com", "g"), "g"), "cluster-edges"), 1.0, levels, sweeps)
        divided = chosen.withColumn("divided", F.lit(True))
        total = stored(total.join(divided, "com", "left").join(parts.withColumnRenamed("com", "part"), "id", "left").select("id", F.when(F.col("divided"), F.coalesce("part", "id")).otherwise(F.col("com")).alias("com")), "cluster")
    return renumber(total)


def _degrees(sent):
    """Weight of the edges of each node in a block, loops twice; of edges within groups."""

    def work(u, v, w):
        group = sent.value
        x = np.where(u == v, 2.0, 1.0) * (1.0 if w is None else w) * (group[u] == group[v])
        at, place = np.unique(u, return_inverse=True)
        return at.astype(np.int32).tobytes(), np.bincount(place, x).tobytes()

    return work


def _moves(sent, turn: int):
    """For a block: nodes whose turn it is and that gain by a move, and where they go."""

    def work(u, v, w):
        labels, k, mass, turns, scale, group = sent.value
        own = (_spoke(turns[u], turn)) & (u != v) & (group[u] == group[v])
        u, v, w = u[own], v[own], np.ones(own.sum()) if w is None else w[own]
        if not len(u):
            return b"", b""
        key = u.astype(np.int64) * len(labels) + labels[v]
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        links = np.add.reduceat(w, first)
        node, to = np.divmod(key[first], len(labels))
        com, deg, two_m = labels[node], k[node], scale[group[node]]
        gain = np.round(links - deg * (mass[to] - np.where(to == com, deg, 0.0)) / two_m, 9)
        order = np.lexsort((to, -gain, node))
        best = order[np.append(True, node[order][1:] != node[order][:-1])]  # one for each node, in their order
        stay = np.round(-deg[best] * (mass[com[best]] - deg[best]) / two_m[best], 9)  # without links to its own
        home = to == com
        stay[np.searchsorted(node[best], node[home])] = gain[home]
        go = best[gain[best] > stay]
        return node[go].astype(np.int32).tobytes(), to[go].astype(np.int32).tobytes()

    return work


def _inside(sent):
    """Weight of a block's edges within communities and groups by group, counted in both directions."""

    def work(u, v, w):
        labels, group = sent.value
        same = (labels[u] == labels[v]) & (group[u] == group[v])
        at, place = np.unique(group[u[same]], return_inverse=True)
        return at.astype(np.int32).tobytes(), np.bincount(place, (np.where(u == v, 2.0, 1.0) * (1.0 if w is None else w))[same], len(at)).tobytes()

    return work


def _sums(rows, n: int) -> np.ndarray:
    out = np.zeros(n)
    for at, x in rows:
        out[np.frombuffer(at, np.int32)] += np.frombuffer(x)
    return out


def _within(blocks: DataFrame, labels: np.ndarray, group: np.ndarray) -> np.ndarray:
    sent = blocks.sparkSession.sparkContext.broadcast((labels, group))
    out = _sums(packed.run(blocks, _inside(sent), "at binary, w binary"), len(labels))
    sent.destroy()
    return out


def _packed_level(blocks: DataFrame, turns: np.ndarray, resolution: float, sweeps: int | None, group: np.ndarray) -> tuple[np.ndarray, int]:
    """The label of each node after local moves from singletons, each group by itself, and the number of nodes that have edges."""
    context, n = blocks.sparkSession.sparkContext, len(turns)
    sent = context.broadcast(group)
    k, labels = _sums(packed.run(blocks, _degrees(sent), "at binary, k binary"), n), np.arange(n, dtype=np.int32)
    sent.destroy()
    two_m = np.bincount(group, k, n)
    two_m[two_m == 0] = 1.0

    def quality(labels, mass):
        return _within(blocks, labels, group) / two_m - resolution * np.bincount(group, mass * mass, n) / two_m**2

    mass = k.copy()
    best, idle = quality(labels, mass), 0
    for sweep in _turns(sweeps):
        sent = context.broadcast((labels, k, mass, turns, two_m / resolution, group))
        new = labels.copy()
        for node, to in packed.run(blocks, _moves(sent, sweep % CYCLE), "node binary, to binary"):
            new[np.frombuffer(node, np.int32)] = np.frombuffer(to, np.int32)
        sent.destroy()
        q = quality(new, np.bincount(new, k, n))
        better = q > best + 1e-9
        idle = 0 if (q > best + SETTLED).any() else idle + 1
        best, labels = np.where(better, q, best), np.where(better[group], new, labels)
        mass = np.bincount(labels, k, n)
        if idle == IDLE:
            break
    return labels, int((k > 0).sum())


def _merged(blocks: DataFrame, labels: np.ndarray) -> DataFrame:
    """(u, v, w) in both directions, loops once, between communities."""
    import pyarrow as pa

    sent = blocks.sparkSession.sparkContext.broadcast(labels)

    def work(batches):
        for b in batches:
            for u, v, w in packed.arrays(b):
                once = u <= v
                a, c = sent.value[u[once]], sent.value[v[once]]
                key, place = np.unique(np.minimum(a, c).astype(np.int64) * len(sent.value) + np.maximum(a, c), return_inverse=True)
                total = np.bincount(place, None if w is None else w[once], len(key)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in np.divmod(key, len(sent.value))] + [pa.array(total)], names=["u", "v", "w"])

    return _both(stored(blocks.mapInArrow(work, "u int, v int, w double").groupBy("u", "v").agg(F.sum("w").alias("w")), "cluster-edges"))


def _packed_parts(blocks: DataFrame, turns: np.ndarray, resolution: float, levels: int | None, sweeps: int | None, group: np.ndarray) -> np.ndarray:
    """The community of each node, named after its smallest member, each group by itself."""
    base, total = blocks, None
    for level in count():
        found, active = _packed_level(blocks, turns, resolution, sweeps, group)
        nodes = active if total is None else len(np.unique(total))
        total = found if total is None else found[total]
        if len(np.unique(total)) == (nodes if level else len(total)) or level + 1 == levels:
            break
        merged = packed.blocks(_merged(blocks, found), len(turns), True)
        if blocks is not base:
            discard(blocks)
        blocks = merged
    if blocks is not base:
        discard(blocks)
    _, first, place = np.unique(total, return_index=True, return_inverse=True)
    return first[place].astype(np.int32)


#: A community of more than this share of the nodes, and of more than so many, is divided by a pass of its own; after
#: that one of so many nodes with less than this share of its possible edges.
SHARE, LEAST, COHESION, LOOSE = 0.25, 10, 0.05, 50
#: Sweeps in a row of no more gain than ``SETTLED`` that end a level: each node has a turn in them.  Sweeps after which turns repeat.
IDLE, SETTLED, CYCLE = 5, 1e-6, 60


def _turns(sweeps: int | None):
    return count() if sweeps is None else range(sweeps)


def _turn(sweep: int) -> Column:
    """Whether it is a node's turn: three sweeps in a row, from one that is divisible by three, have all."""
    at = sweep % CYCLE
    return F.pmod(F.xxhash64("id", F.lit(at // 3)), F.lit(3)) == at % 3


def _spoke(turns: np.ndarray, at: int) -> np.ndarray:
    """The same, with two bits for each three sweeps."""
    return (turns >> (2 * (at // 3))) & 3 == at % 3


def communities(simple: DataFrame, resolution: float = 1.0, levels: int | None = None, sweeps: int | None = None, split: bool = True) -> DataFrame:
    """(id, community): 0 is the largest; equal sizes by their smallest member.

    ``simple`` has pairs (lo, hi).  Sweeps go on until they have settled, and levels until nothing merges, unless they are bounded.  Then
    communities that are too large are split at a resolution of 1, and after them those of too few edges.
    """
    pairs = stored(simple.select("lo", "hi"), "cluster-base")
    ids = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    if not packed.within(ids, packed.NODES):
        return _by_joins(pairs, resolution, levels, sweeps, split)
    numbers, n = packed.numbered(ids)
    mask = sum((F.shiftleft(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(3)).cast("long"), 2 * s) for s in range(CYCLE // 3)), F.lit(0).cast("long"))
    turns = packed.node_column(numbers, mask, np.int64, n)
    base = packed.ends(pairs, numbers, "lo", "hi").select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(1.0).alias("w"))
    blocks = packed.blocks(_both(base), n, False)
    total = _packed_parts(blocks, turns, resolution, levels, sweeps, np.zeros(n, np.int32))
    for many in (True, False) if split else ():
        size = np.bincount(total, minlength=n)
        if many:
            chosen = size > max(LEAST, int(n * SHARE))
        else:
            chosen = (size >= LOOSE) & (_within(blocks, total, total) / 2 < COHESION * size * (size - 1) / 2)
        own = chosen[total]
        if own.any():
            parts = _packed_parts(blocks, turns, 1.0, levels, sweeps, np.where(own, total, np.arange(n, dtype=np.int32)))
            total = np.where(own, parts, total)
    discard(blocks, pairs)
    com, first, place, size = np.unique(total, return_index=True, return_inverse=True, return_counts=True)
    rank = np.zeros(len(com), np.int32)
    rank[np.lexsort((first, -size))] = np.arange(len(com), dtype=np.int32)
    return packed.with_values(numbers, rank[place], "community", "int")


def with_isolates(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community) with each node that has none in one of its own."""
    labels = stored(labels, "communities")
    rest = stored(nodes.select("id").distinct().join(labels, "id", "left_anti"), "isolates")
    if rest.isEmpty():
        return labels
    return renumber(labels.select("id", F.col("community").cast("string").alias("com")).union(rest.select("id", F.concat(F.lit("alone "), "id").alias("com"))))


def renumber(labels: DataFrame) -> DataFrame:
    by = labels.groupBy("com").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    ranked = by.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1)
    return labels.join(ranked.select("com", "community"), "com").select("id", "community")


def split_oversized(simple: DataFrame, labels: DataFrame, share: float = 0.25, least: int = 10) -> DataFrame:
    """(id, community) with each community of more than ``share`` of the nodes divided by a pass of its own."""
    n = labels.count()
    big = [r[0] for r in labels.groupBy("community").count().filter(F.col("count") > max(least, int(n * share))).collect()]
    out = labels.select("id", F.col("community").cast("string").alias("com"))
    for c in big:  # four at most at a share of a quarter
        own = labels.filter(F.col("community") == c).select("id")
        inside = simple.join(own.withColumnRenamed("id", "lo"), "lo").join(own.withColumnRenamed("id", "hi"), "hi")
        parts = communities(inside, split=False).select("id", F.concat(F.lit(f"{c}."), F.col("community").cast("string")).alias("part"))
        out = out.join(parts, "id", "left").select("id", F.coalesce("part", "com").alias("com"))
    return renumber(out)


def remap(now: DataFrame, before: DataFrame) -> DataFrame:
    """(id, community) with ids of the assignment before, where communities overlap most.

    Overlaps are counted by a join; the one-to-one choice among communities, largest first, is made on the driver.
    """
    overlap = now.join(before.select("id", F.col("community").alias("old")), "id").groupBy("old", F.col("community").alias("new")).agg(F.count(F.lit(1)).alias("n")).collect()
    to: dict[int, int] = {}
    used: set[int] = set()
    for r in sorted(overlap, key=lambda r: (-r["n"], r["old"], r["new"])):
        if r["old"] not in used and r["new"] not in to:
            to[r["new"]] = r["old"]
            used.add(r["old"])
    rest = now.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect()
    free = 0
    for r in sorted(rest, key=lambda r: (-r["n"], r["first"])):
        if r["community"] in to:
            continue
        while free in used:
            free += 1
        to[r["community"]] = free
        used.add(free)
    table = now.sparkSession.createDataFrame(sorted(to.items()), "community int, final int")
    return now.join(table, "community").select("id", F.col("final").alias("community"))
