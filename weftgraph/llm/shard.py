"""Sharding by a k-d tree over document metadata.

The tree starts with all the documents and all the shards.  A node with k > 1 shards is
split along the dimension in which it is widest, at the weighted median (for odd
k the k // 2 : k - k // 2 quantile), so that every leaf gets the target bytes.
The medians of all the nodes of a level are found together by distributed
histograms that narrow around each cut; the driver sees a bounded number of
histogram cells and never rows.

Where a dimension ties, documents are ordered by a hash of the text, then of the
id, then by a number of the row: copies of a text stay together unless a cut must fall among them, and a hot
value, a hot group of copies or of rows with one id is split like any other run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

CELLS = 1024
#: Rows numbered by one task.
SLOT_ROWS = 2000


@dataclass
class Node:
    """``shards`` shards from ``first`` on; a split node has a dimension, a cut and two children."""

    id: int
    first: int
    shards: int
    dim: int = 0
    cut: int = 0
    left: int = 0
    right: int = 0


def _pick(nodes: list[Node], value) -> Column:
    """A value of the row's node: a literal array of at most 2 * shards entries, by node id."""
    return F.element_at(F.array(*(F.lit(int(value(x))).cast("long") for x in nodes)), F.col("_n") + 1)


#: Bits of the parts of a key, 63 together: dimension, hash of the text, hash of the id, number of the row.
DIM_BITS, TEXT_BITS, ID_BITS, ROW_BITS = 16, 25, 11, 11


def _key(nodes: list[Node], dims: int) -> Column:
    """The place of a row along the dimension of its node."""
    x = F.element_at(F.array(*(F.col(f"_x{i}") for i in range(dims))), _pick(nodes, lambda n: n.dim).cast("int") + 1)
    return F.shiftleft(x, 63 - DIM_BITS) + F.shiftleft(F.col("_t"), ID_BITS + ROW_BITS) + F.shiftleft(F.col("_r"), ROW_BITS) + F.col("_o")


def _row_number() -> Column:
    """A number of ROW_BITS for the row: consecutive rows of a task have consecutive ones, and those of tasks are apart."""
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return F.pmod(nth + F.spark_partition_id() * F.lit(257), F.lit(1 << ROW_BITS))


def _descend(df: DataFrame, nodes: list[Node], dims: int) -> DataFrame:
    """Rows of split nodes go on to a child; a leaf stays."""
    to = F.when(_key(nodes, dims) < _pick(nodes, lambda x: x.cut), _pick(nodes, lambda x: x.left or x.id)).otherwise(_pick(nodes, lambda x: x.right or x.id))
    return df.withColumn("_n", to.cast("int"))


def _cut_level(placed: DataFrame, nodes: list[Node], level: list[Node], totals: dict[int, int], dims: int, tolerance: int) -> None:
    """Sets each node's cut: the key at which its left shards are full."""
    end = (1 << 63) - 1
    lo, hi, below = ({x.id: v for x in level} for v in (0, end, 0))
    want = {x.id: totals.get(x.id, 0) * (x.shards // 2) // x.shards for x in level}
    live = {x.id: x for x in level}
    while live:
        width = {i: max(1, -(-(hi[i] - lo[i]) // CELLS)) for i in live}
        own = lambda values, other: _pick(nodes, lambda x: values[x.id] if x.id in live else other)  # noqa: B023, E731
        last = {i: max(lo[i], hi[i] - 1) for i in live}
        keyed = placed.select("_n", "_size", _key(nodes, dims).alias("_k"), own(lo, 0).alias("_lo"), own(last, -1).alias("_last"), own(width, 1).alias("_w")).filter("_k BETWEEN _lo AND _last")
        rows = keyed.groupBy("_n", F.expr("(_k - _lo) div _w").alias("_c")).agg(F.sum("_size"), F.count(F.lit(1))).collect()
        cells: dict[int, list[tuple[int, int, int]]] = {}
        for n, c, w, count in rows:
            cells.setdefault(n, []).append((c, w, count))
        for i in list(live):
            acc, more = below[i], False
            cut = lo[i] if not cells.get(i) else hi[i]
            for c, w, count in sorted(cells.get(i, [])):
                a, b = lo[i] + c * width[i], min(hi[i], lo[i] + (c + 1) * width[i])
                if acc + w > want[i]:
                    if w > tolerance and count > 1 and b - a > 1:
                        lo[i], hi[i], below[i], more = a, b, acc, True
                    cut = a if want[i] - acc <= acc + w - want[i] else b
                    break
                acc += w
            if not more:
                live.pop(i).cut = cut


def kd_shards(docs: DataFrame, shards: int, dims: list[Column], size: Column, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """One row for each row of ``docs``: the id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``dims`` are numeric metadata of any range (null counts as the smallest value); they
    are scaled to 16 bits over their range in ``docs``.  Sizes of shards differ by little
    more than a document, or ``tolerance`` of a shard.  Null texts weigh as empty; repeated
    rows and rows without an id are placed each by itself, by numbers that are fixed when the metadata are written; with no rows there are no shards; a row larger than
    a shard leaves others emptier.  Slots are gapless from 0 in each shard.
    """
    n = len(dims)
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = docs.select(F.col(id_col), size.cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS).alias("_t"), F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << ID_BITS)).alias("_r"), _row_number().alias("_o"), *(d.cast("double").alias(f"_d{i}") for i, d in enumerate(dims)))
    meta = stored(meta, "shard-meta")
    ends = meta.agg(F.count(F.lit(1)), *(f(f"_d{i}") for i in range(n) for f in (F.min, F.max))).first()
    scaled = {}
    for i in range(n):
        lo, hi = ends[1 + 2 * i], ends[2 + 2 * i]
        span = (hi - lo) if lo is not None and hi > lo else 1.0
        scaled[f"_x{i}"] = F.coalesce(F.least(F.lit(65535), F.floor((F.col(f"_d{i}") - F.lit(lo or 0.0)) / F.lit(span) * 65535)), F.lit(0)).cast("long")
    placed = meta.withColumns(scaled).drop(*(f"_d{i}" for i in range(n))).withColumn("_n", F.lit(0))
    nodes = [Node(0, 0, shards)]
    before = meta
    while level := [x for x in nodes if x.shards > 1 and not x.right]:
        placed = stored(placed, "shard-level")
        discard(before)
        before = placed
        stats = placed.groupBy("_n").agg(F.sum("_size"), *(F.max(f"_x{i}") - F.min(f"_x{i}") for i in range(n))).collect()
        widths = {r[0]: r[2:] for r in stats}
        totals = {r[0]: r[1] for r in stats}
        for x in level:
            x.dim = max(range(n), key=lambda d, w=widths.get(x.id, (0,) * n): (w[d], -d))
        leaf_bytes = sum(totals.values()) / shards
        _cut_level(placed, nodes, level, totals, n, int(tolerance * leaf_bytes))
        for x in level:
            h = x.shards // 2
            x.left, x.right = len(nodes), len(nodes) + 1
            nodes += [Node(x.left, x.first, h), Node(x.right, x.first + h, x.shards - h)]
        placed = _descend(placed, nodes, n)
    placed = placed.withColumn("shard", _pick(nodes, lambda x: x.first).cast("int"))
    subs = max(1, -(-ends[0] // (SLOT_ROWS * shards)))
    placed = placed.withColumn("_s", F.pmod(F.xxhash64("_t", "_r", "_o", F.lit(3)), F.lit(subs)).cast("int"))
    counts = placed.groupBy("shard", "_s").agg(F.count(F.lit(1)).alias("_c"))
    ahead = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("shard").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_s", F.coalesce("_before", F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("shard", "_s").orderBy("_t", "_r", "_o", id_col)) - 1
    return placed.withColumn("_nth", nth).join(ahead, ["shard", "_s"]).select(id_col, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_nth") + F.col("_before")).cast("long").alias("slot"))


def document_dims() -> list[Column]:
    """Source and language (by the crc32 of the name) and the logarithm of the length."""
    name = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    return [name("source"), name("lang"), F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 16)]


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    return kd_shards(docs, shards, document_dims(), size)


def query(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
