"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p**a, normalised.  The exponent a in
[0, 1] is found by bisection (of 32 parts a step): 1 keeps the corpus as it is, 0 makes all sources
equal; the entropy of the weights and the repetition of small sources both fall as a
rises.  With a target entropy the largest a that still has it is taken; with
a repetition limit the smallest a that keeps every source within it; with both, the larger.

Weights become token budgets, and budgets whole passes over a source and a part of one.  A
pass is a permutation of blocks: blocks are hash ranges of the source, in an order
drawn anew for each pass, with the rows of a block in a hashed order too.  The part pass
ends where its budget does, found block by block, then by ever smaller ranges within the last block, so
neither a source nor a block is ever sorted as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import discard, stored, table, with_fields

BLOCKS = 1024
#: Rows of a part pass's last cell that are ordered in one task.
FEW = 4096
#: Up to so many different token counts of sources are summed on the driver, more by the executors.
DRIVER_COUNTS = 100_000


def sums_of(tokens: dict[int, int]):
    """For exponents, the sums of p**a and of p**a log p**a over sources given as {tokens: sources}."""
    t, many = np.array(list(tokens), float), np.array(list(tokens.values()), float)
    logs = np.log(t / (t * many).sum())

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        return [(float((many * np.exp(a * logs)).sum()), float((many * a * logs * np.exp(a * logs)).sum())) for a in exponents]

    return sums


def sums_by(counts: DataFrame, total: int):
    """As ``sums_of``, for a table of any size with a row (t, n) for n sources of t tokens."""

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        log = F.log(F.col("t") / F.lit(float(total)))
        cols = [f for a in exponents for f in (F.sum(F.col("n") * F.exp(log * a)), F.sum(F.col("n") * log * a * F.exp(log * a)))]
        got = counts.agg(*cols).first()
        return [(got[2 * i], got[2 * i + 1]) for i in range(len(exponents))]

    return sums


def exponent(sums, least_share: float, budget_share: float, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent that meets the targets, as far as exponents in [0, 1] can.

    ``sums`` as above; ``least_share``: of the smallest source; ``budget_share``: budget by tokens.
    The entropy of the weights is log Z - E / Z, and the most repeated source is the smallest.
    """

    def largest(ok, sections: int = 32, steps: int = 11) -> float:
        """The largest exponent for which ``ok``, which holds up to some exponent."""
        lo, hi = 0.0, 1.0
        if ok(1.0, *sums([1.0])[0]):
            return 1.0
        for _ in range(steps):
            grid = [lo + (hi - lo) * i / sections for i in range(1, sections)]
            good = [x for x, z in zip(grid, sums(grid), strict=True) if ok(x, *z)]
            lo, hi = (good[-1] if good else lo), (grid[len(good)] if len(good) < len(grid) else hi)
        return lo

    a = 1.0 if target_entropy is None else largest(lambda _, z, e: math.log(z) - e / z >= target_entropy)
    if max_repeats is not None:
        over = lambda x, z, _: budget_share * least_share ** (x - 1) / z > max_repeats * (1 + 1e-12)
        floor = 0.0 if not over(0.0, *sums([0.0])[0]) else largest(over)
        a = max(a, floor) if target_entropy is not None else floor
    return a


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_tokens``: words split at ASCII white space (null: none)."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = tk.text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        _, _, woff = tk.spans(data, off, tk.NONSPACE)
        return {"_tokens": pa.array(np.diff(woff), pa.int64())}

    return docs.mapInArrow(tk.appending(add, text_col), with_fields(docs, ("_tokens", T.LongType())))


def _order(key: Column, seed: int, epoch: Column) -> tuple[Column, Column, Column]:
    """Block, its place in the pass (with the block as tie-break), and the row's place in it."""
    block = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOCKS))
    place = F.shiftleft(F.shiftrightunsigned(F.xxhash64(block, epoch, F.lit(seed)), 12), 10) + block
    return block, place, F.shiftrightunsigned(F.xxhash64(key, epoch, F.lit(seed), F.lit(11)), 1)


def budgets(sized: DataFrame, target_entropy: float | None, entropy_share: float | None, max_repeats: float | None, budget: int | None) -> DataFrame:
    """(src, mix_weight, passes, rest) of each source with tokens in ``sized`` (src, tokens, ...)."""
    sources = stored(sized.groupBy("src").agg(F.sum("tokens").alias("t")).filter("t > 0"), "mix-sources")
    total, least, n = sources.agg(F.sum("t"), F.min("t"), F.count(F.lit(1))).first()
    if not n:
        return sources.select("src", F.lit(0.0).alias("mix_weight"), F.col("t").alias("passes"), F.col("t").alias("rest"))
    budget = total if budget is None else budget
    if entropy_share is not None:
        target_entropy = entropy_share * math.log(n)
    counts = sources.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(DRIVER_COUNTS + 1).collect() if n <= DRIVER_COUNTS else None
    sums = sums_of({r[0]: r[1] for r in sorted(few)}) if few else sums_by(stored(counts, "mix-counts"), total)
    a = exponent(sums, least / total, budget / total, target_entropy, max_repeats)
    weight = F.exp(F.log(F.col("t") / F.lit(float(total))) * a) / sums([a])[0][0]
    tokens = F.floor(F.col("mix_weight") * budget + 1e-9)  # a whole number may come out a little less
    out = sources.withColumn("mix_weight", weight).withColumn("b", tokens)
    return stored(out.select("src", "mix_weight", F.expr("b div t").alias("passes"), F.expr("b % t").alias("rest")), "mix-budgets")


def part_ends(sized: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """(src, last_place, last_nth, last_key): where the part pass of each source ends.

    First the block in which it ends is found, then a range of the rows' places in it, a tenth of
    their bits at a time, until the range of every source is small enough to be ordered.
    """
    _, place, nth = _order(F.col("key"), seed, F.col("passes"))
    own = planned.filter("rest > 0").withColumnRenamed("src", "_src")
    part = sized.join(own, F.col("src").eqNullSafe(F.col("_src"))).select("src", "rest", "key", "tokens", place.alias("place"), nth.alias("nth"))

    def ending(cells: DataFrame) -> DataFrame:
        """The cell (src, rest, start, cell, t) of each source in which its budget ends."""
        before = F.coalesce(F.sum("t").over(Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("start")
        return cells.withColumn("before", before).filter("before <= rest AND before + t > rest")

    blocks = part.groupBy("src", "rest", F.col("place").alias("cell")).agg(F.sum("tokens").alias("t")).withColumn("start", F.lit(0).cast("long"))
    cut = stored(ending(blocks).select(F.col("src").alias("_s"), F.col("cell").alias("last_place"), F.lit(0).cast("long").alias("low"), F.col("before").alias("start")), "mix-cut")
    in_block = F.col("src").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("last_place"))
    for shift in (53, 43, 33, 23, 13, 3):
        inside = part.join(cut, in_block & (F.shiftrightunsigned("nth", shift + 10) == F.col("low")))
        if not (inside.groupBy("src").count().agg(F.max("count")).first()[0] or 0) > FEW:
            break
        cells = inside.groupBy("src", "rest", "last_place", "start", F.shiftrightunsigned("nth", shift).alias("cell")).agg(F.sum("tokens").alias("t"))
        finer = stored(ending(cells).select(F.col("src").alias("_s"), "last_place", F.col("cell").alias("low"), F.col("before").alias("start")), "mix-cut")
        discard(cut)
        cut = finer
    else:
        shift = -7
    inside = part.join(cut, in_block & (F.shiftrightunsigned("nth", shift + 10) <= F.col("low")))
    # rows before the last cell come in any case; those of the cell in order, as long as they fit
    rows = inside.filter(F.shiftrightunsigned("nth", shift + 10) == F.col("low")).groupBy("src", "rest", "start", "nth", "key").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("src").orderBy("nth", "key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("start")
    ends = rows.withColumn("upto", upto).filter("upto <= rest").groupBy("src").agg(F.max(F.struct("nth", "key")).alias("end"))
    first = F.shiftleft(F.col("low"), shift + 10)  # nothing of the cell fits: the end is just before it
    out = cut.join(ends, F.col("_s").eqNullSafe(F.col("src")), "left").select(F.col("_s").alias("src"), "last_place", F.coalesce("end.nth", first).alias("last_nth"), F.coalesce("end.key", F.lit(-(1 << 63))).alias("last_key"))
    out = stored(out, "mix-ends")
    discard(cut)
    return out


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "mix_", entropy_share: float | None = None) -> DataFrame:
    """``docs`` repeated or cut to the budgets, with weight, pass, block, place and nth, named with ``prefix``.

    The order of the mixture within a source is (pass, place, nth).  ``budget`` counts
    tokens (default: those of ``docs``); ``entropy_share`` gives the target as a share of the entropy of equal sources.
    Null is a source of its own, and sources without tokens have no share and no rows; rows without tokens
    come with every whole pass and with the part pass up to its end; a row is known by id and text, and
    repeated rows share their place and come together or not at all; without tokens, the result is empty.
    """
    w, e, b, p, r = names = [prefix + c for c in ("weight", "pass", "block", "place", "nth")]
    docs = docs.drop(*names)
    key = F.xxhash64(id_col, text_col)
    sized = stored(count_tokens(docs.select(key.alias("key"), F.col(source_col).alias("src"), F.col(text_col).alias("text")), "text").select("key", "src", F.col("_tokens").alias("tokens")), "mix-tokens")
    planned = budgets(sized, target_entropy, entropy_share, max_repeats, budget)
    ends = part_ends(sized, planned, seed).withColumnRenamed("src", "_s")
    # a small table for each source; Spark broadcasts it if its size allows
    own = stored(planned.join(ends, F.col("src").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")
    discard(sized, planned, ends)
    own = own.select(*(F.col(c).alias(f"_mix_{c}") for c in own.columns))
    q = {c.removeprefix("_mix_"): F.col(c) for c in own.columns}
    block, place, nth = _order(F.col("_mix_key"), seed, F.col(e))
    passes = F.explode(F.sequence(F.lit(0).cast("long"), q["passes"]))
    spread = docs.withColumn("_mix_key", key).join(own, F.col(source_col).eqNullSafe(q["src"])).withColumn(e, passes)
    spread = spread.withColumns({w: q["mix_weight"], b: block, p: place, r: nth})
    up_to = F.struct(F.col(r), F.col("_mix_key")) <= F.struct(q["last_nth"], q["last_key"])
    in_part = (F.col(p) < q["last_place"]) | ((F.col(p) == q["last_place"]) & up_to)
    keep = (F.col(e) < q["passes"]) | ((q["rest"] > 0) & F.coalesce(in_part, F.lit(False)))
    return spread.filter(keep).drop("_mix_key", *own.columns)


#: Share of the greatest possible entropy, and greatest number of passes over a source.
ENTROPY_SHARE, MAX_REPEATS = 0.97, 4.0


def mix_documents(docs: DataFrame, prefix: str = "mix_") -> DataFrame:
    """Production parameters: 0.97 of the entropy of equal sources, at most 4 passes."""
    return mix(docs, entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS, prefix=prefix)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_documents(docs).drop("text")
