"""Near-duplicate detection by min-max hashing.

A text's set is hashed with half as many permutations as the signature has values:
each permutation gives its minimum and its maximum, both of which agree between two
sets with the probability of their Jaccard similarity.  Bands of the signature are
buckets of candidate texts.

Texts with equal sets form a class, and only one of each class is banded.  Links
are confirmed on the full sets.  A bucket is not expanded into pairs.  Its
pivot, a member of the largest buckets, is compared with all its members.  Links among
those within a wide radius of the pivot are found by their differences to it: for |x ^ y| to be
small enough, x and y must share so many of these that the rarest ones of each (a prefix,
with the position of the shared one bounding what can follow) decide whether they are
compared at all.  Differences are mostly edits of one text, so few pairs meet.  Members
far within the radius are done then; the rest meets many times as many pivots in each of a few rounds.  What no
pivot settles is joined by the prefixes of the full sets, which is exact whatever the
bucket looks like.  A bucket is also done once it lies in one component.

No step gathers a bucket: the members of a pivot are dealt over as many tasks as their number
asks for, each of which gets the pivot's set once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import by_bitmap, discard, id_bitmap, stored, table
from .components import components

BANDS, PER_BAND = 40, 3  # permutations of a band: 6 values of the signature
#: Sets of at most so many shingles have more bands, as the two ends of a small set depend on each other.
SMALL, MORE = 64, 24
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**63, (BANDS + MORE) * PER_BAND, dtype=np.uint64) * tk.U64(2) + tk.U64(1)
_B = _RNG.integers(0, 2**63, (BANDS + MORE) * PER_BAND, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and n + 1 offsets."""
    data, off = tk.text_bytes(column)
    parts, sizes = [], np.zeros(len(off) - 1, np.int64)
    for i, j in tk.slices(off):
        x = tk.LOWER[data[off[i] : off[j]]]
        s, e, wo = tk.spans(x, off[i : j + 1] - off[i], tk.NONSPACE)
        h = tk.span_hashes(x, s, e)
        n = np.diff(wo)
        # whole sequences of texts with too few words, shingles of the others
        grams = tk.ngram_hashes(h, words)
        count = np.where(n >= words, n - words + 1, 0)
        row, nth = tk.expand(count)
        value = grams[wo[row] + nth] if len(grams) else np.zeros(0, tk.U64)
        short = np.flatnonzero((n > 0) & (n < words))
        if len(short):
            own = [tk.ngram_hashes(h[wo[r] : wo[r + 1]], int(n[r]))[0] ^ tk.U64(n[r]) for r in short]
            row, value = np.concatenate([row, short]), np.concatenate([value, np.array(own, tk.U64)])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        parts.append(value[new])
        sizes[i:j] = np.bincount(row[new], minlength=j - i)
    return (np.concatenate(parts) if parts else np.zeros(0, tk.U64)), np.concatenate([[0], np.cumsum(sizes)])


def _bands(value: np.ndarray, off: np.ndarray, first: int, last: int) -> np.ndarray:
    """Keys of the bands from ``first`` to ``last`` for each row."""
    out = np.zeros((len(off) - 1, last - first), np.uint64)
    for b in range(first, last):
        key = np.full(len(off) - 1, b, np.uint64)
        for p in range(b * PER_BAND, (b + 1) * PER_BAND):
            x = value * _A[p] + _B[p]
            for f in (np.minimum, np.maximum):
                key = tk.mix(key * tk.U64(0x2545F4914F6CDD1D) + tk.segment_reduce(f, x, off, tk.U64(0)))
        out[:, b - first] = key
    return out


def _signatures(column: pa.Array, words: int) -> dict[str, pa.Array]:
    value, off = shingle_sets(column, words)
    n = np.diff(off)
    with np.errstate(over="ignore"):
        total = tk.segment_reduce(np.add, tk.mix(value), off, tk.U64(0))
        xor = tk.segment_reduce(np.bitwise_xor, tk.mix(value ^ tk.U64(0x5DEECE66D)), off, tk.U64(0))
        bands = _bands(value, off, 0, BANDS)
        small = np.flatnonzero(n <= SMALL)
        row, nth = tk.expand(n[small])
        more = _bands(value[off[small][row] + nth], np.concatenate([[0], np.cumsum(n[small])]), BANDS, BANDS + MORE)
    count = np.full(len(n), BANDS)
    count[small] += MORE
    at = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(at[-1], np.uint64)
    flat[at[:-1, None] + np.arange(BANDS)] = bands
    flat[at[small][:, None] + BANDS + np.arange(MORE)] = more
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
    return {"n_shingles": pa.array(n, pa.int64()), "_s1": pa.array(total.view(np.int64)), "_s2": pa.array(xor.view(np.int64)), "_bands": lists}


def _mapped(docs: DataFrame, make, fields: str) -> DataFrame:
    """The columns of ``docs`` before the last one, its text, with those ``make`` computes from the text."""
    first = docs.schema.fields[:-1]
    schema = T.StructType([*first, *T._parse_datatype_string(fields).fields])

    def run(batches):
        for batch in batches:
            for part in tk.sub_batches(batch, "text", tk.SLICE_BYTES) if batch.num_rows else ():
                new = make(part.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new.values()], names=schema.names)

    return docs.mapInArrow(tk.handing_back(run), schema)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with n_shingles, _s1, _s2 and _bands for the text, its last column; the two
    sums identify the set."""
    return _mapped(docs, lambda text: _signatures(text, words), "n_shingles long, _s1 long, _s2 long, _bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with ``set``, the sorted shingle hashes of the text, its last column, in eight bytes each."""

    def make(text):
        value, off = shingle_sets(text, words)
        raw = value.tobytes()
        return {"set": tk.binary_array([raw[8 * a : 8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])}

    return _mapped(docs, make, "set binary")


#: Pairs compared before their rows are handed on.
PAIRS = 256
#: Members of a group that one task gets for each of its groups.
MEMBERS = 256
#: Pivots of a bucket grow by this factor each round.
GROWTH = 16
#: Rounds with pivots, before the rest is joined by its sets.
ROUNDS = 4
#: Radius around a pivot, in units of the difference that two linked sets of its size may have.
RADIUS = 4


def _salt(members: str, of: str, share: int = MEMBERS):
    """Part of a group of ``members`` rows that a row belongs to."""
    return F.pmod(F.xxhash64(of, F.lit(5)), F.ceil(F.col(members) / share)).cast("int")


def compared(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, m, na, nb, linked, settled, delta) of pairs (a, b, m) of ids; ``m`` says about how many pairs ``a`` has.

    ``linked``: 100 * intersection >= per_cent * union.  ``delta``: the elements of one set only, if b is
    within the radius of a, else null.  ``settled``: b is linked, or so far within that it can't be
    linked to a set beyond.  A task reads the set of ``a``, then streams those of its share of partners.
    """
    dealt = pairs.select("a", "b", "m", _salt("m", "b").alias("salt"))
    ends = dealt.select("a", "salt", F.lit(0).cast("long").alias("m"), F.col("a").alias("id")).distinct().union(dealt.select("a", "salt", "m", "b"))
    # the set of ``a`` has no m and comes first
    rows = ends.join(sets, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "m").select("m", "id", "set")
    share = (100 - per_cent) / (100 + per_cent)
    names = ["a", "b", "m", "na", "nb", "linked", "settled", "delta"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]

    def run(batches):
        a, x = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                out: list[list] = [[] for _ in names]
                for m, i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    y = np.frombuffer(raw.as_buffer(), np.uint64)
                    if not m:
                        a, x = i, y.copy()
                        continue
                    diff = np.setxor1d(x, y, assume_unique=True)
                    total = len(x) + len(y)  # of it the intersection counts twice
                    radius = 2 * RADIUS * share * len(x)
                    linked = 100 * (total - len(diff)) >= per_cent * (total + len(diff))
                    settled = linked or len(diff) + share * len(y) * (1 + 100 / per_cent) + 1e-6 <= radius
                    row = (a, i, m, len(x), len(y), linked, settled, diff.view(np.int64) if len(diff) <= radius + 1e-6 else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return rows.mapInArrow(tk.handing_back(run), "a long, b long, m long, na long, nb long, linked boolean, settled boolean, delta array<long>")


def meeting(items: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b, m) of items of one group that may be linked by what their elements share.

    An item (g, m, b, comp, nb, elements, keep, keep_any, late) is a set of nb elements, of which those in ``elements`` differ from
    what its group, of about m items, has in common.  Items of one component don't meet, nor two with ``late``.  ``keep`` and
    ``keep_any``: how many of an item's rarest elements any partner without ``late``, or any at all, must share one of.
    """
    share = (100 - per_cent) / (100 + per_cent)
    items = stored(items, "items")
    d = items.withColumn("d", F.size("elements"))
    e = d.select("g", "b", "comp", "nb", "d", "late", "keep", "keep_any", _salt("m", "b").alias("salt"), F.explode("elements").alias("e"))
    # an element of a whole group is counted and told part by part
    parts = e.groupBy("g", "e", "salt").agg(F.count(F.lit(1)).alias("c"))
    often = parts.groupBy("g", "e").agg(F.sum("c").alias("often")).filter("often > 1")
    shared = e.join(parts.join(often, ["g", "e"]).select("g", "e", "salt", "often"), ["g", "e", "salt"])
    rank = F.row_number().over(Window.partitionBy("g", "b").orderBy("often", "e"))
    # elements of one item only come first in every order, but never meet
    alone = F.col("d") - F.count(F.lit(1)).over(Window.partitionBy("g", "b"))
    ranked = stored(shared.withColumn("r", rank + alone).filter("r <= greatest(keep, keep_any)").drop("salt", "often"), "prefixes")
    x = ranked.filter("r <= keep").select("g", "e", F.col("b").alias("x"), F.col("comp").alias("xc"), F.col("nb").alias("nx"), F.col("d").alias("dx"), F.col("r").alias("rx"))
    y = ranked.filter("NOT late AND r <= keep_any").select("g", "e", F.col("b").alias("y"), F.col("comp").alias("yc"), F.col("nb").alias("ny"), F.col("d").alias("dy"), F.col("r").alias("ry"))
    overlap = F.ceil((F.col("dx") + F.col("dy") - share * (F.col("nx") + F.col("ny"))) / 2 - 1e-6)
    fits = (F.col("dx") - F.col("rx") + 1 >= overlap) & (F.col("dy") - F.col("ry") + 1 >= overlap)
    hit = x.join(y, ["g", "e"]).filter((F.col("xc") != F.col("yc")) & (100 * F.least("nx", "ny") >= per_cent * F.greatest("nx", "ny")) & fits)
    pairs = stored(hit.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    out = stored(pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")), "a"), "beside")
    discard(items, ranked, pairs)
    return out


def _with_comp(df: DataFrame, label: DataFrame | None, node: str) -> DataFrame:
    """``df`` with ``comp``, the label of the column ``node``, which is its own where it has none."""
    if label is None:
        return df.withColumn("comp", F.col(node))
    return df.join(label.select(F.col("node").alias(node), "root"), node, "left").withColumn("comp", F.coalesce("root", node)).drop("root")


def needed(hits: DataFrame) -> DataFrame:
    """Pivots (a), of which each row (key, rep) of ``hits`` (key, pivot, rep) has one.

    A rep that is settled in a ball meets all its partners there, so one ball settles it; the same few serve most reps, as the
    one with the most rows is taken.
    """
    size = hits.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    best = F.max(F.struct("size", F.xxhash64("pivot").alias("h"), "pivot")).getField("pivot")
    return hits.join(size, "pivot").groupBy("key", "rep").agg(best.alias("a")).select("a").distinct()


def beside(balls: DataFrame, label: DataFrame | None, per_cent: int) -> DataFrame:
    """Pairs within the radius of one pivot, of two components, that may be linked."""
    share = (100 - per_cent) / (100 + per_cent)
    d = balls.filter("delta IS NOT NULL").withColumn("d", F.size("delta")).withColumn("salt", _salt("m", "b"))
    open_ = _with_comp(d.select("a", "m", "b"), label, "b").groupBy("a").agg(F.max("m").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / MEMBERS).cast("int") - 1)).alias("salt")
    d = d.join(open_.select("a", parts), ["a", "salt"], "left_semi")
    # the least overlap with any set that isn't linked to the pivot, and with any set at all
    floor = lambda x: F.floor(x / 2 - 1e-9).cast("int") + 1
    least = floor(F.col("d") + share * (F.col("na") - F.col("nb")))
    least_any = F.greatest(F.lit(1), floor(F.col("d") - share * (F.col("na") + F.col("nb"))))
    items = d.select(F.col("a").alias("g"), "m", "b", "nb", F.col("delta").alias("elements"), (F.col("d") - least + 1).alias("keep"), (F.col("d") - least_any + 1).alias("keep_any"), F.col("linked").alias("late"))
    return meeting(_with_comp(items, label, "b"), per_cent)


def among(rest: DataFrame, sets: DataFrame, label: DataFrame | None, per_cent: int) -> DataFrame:
    """Pairs of the ids in ``rest`` that may be linked, by the prefixes of their full sets."""

    def run(batches):
        for batch in batches:
            raw = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(raw), np.int64)), batch.column(0), pa.array(raw, pa.list_(pa.int64()))], names=["g", "b", "elements"])

    whole = sets.join(rest, "id", "left_semi").select("id", "set").mapInArrow(tk.handing_back(run), "g long, b long, elements array<long>")
    items = whole.select("g", F.lit(rest.count()).alias("m"), "b", F.size("elements").alias("nb"), "elements", F.lit(False).alias("late"))
    # a linked partner has per_cent of the elements at least
    keep = F.col("nb") - F.ceil(F.col("nb") * per_cent / 100 - 1e-9).cast("int") + 1
    return meeting(_with_comp(items.withColumns({"keep": keep, "keep_any": keep}), label, "b"), per_cent)


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (node, root) after more links (a, b)."""
    if links.isEmpty():
        return label
    if label is None:
        return components(links)
    root = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    lifted = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(lifted)
    moved = label.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    out = stored(moved.union(joined.join(label, "node", "left_anti").select("node", "root")), "labels")
    discard(label, joined)
    return out


def linked_classes(classes: DataFrame, sets_of, per_cent: int) -> DataFrame | None:
    """Labels (node, root) of the classes (cid, n_shingles, _bands) that are linked to others.

    ``sets_of`` gives (id, set) for a table of class ids.
    """
    # a set of 3 or fewer is at most 3/4 similar to any other
    least = next(n for n in range(1, 1000) if 100 * n >= per_cent * (n + 1))
    entries = classes.filter(F.col("n_shingles") >= least).select(F.col("cid").alias("rep"), F.explode("_bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("key")
    bucket = stored(entries.join(shared, "key"), "buckets")
    sets = stored(sets_of(bucket.select(F.col("rep").alias("id")).distinct()), "sets")
    label = None
    for turn in range(ROUNDS + 1):
        labelled = _with_comp(bucket, label, "rep")
        open_ = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi").select("key", "members")
        live = stored(labelled.join(open_, "key").select("key", "rep", "members"), "live")
        if live.isEmpty():
            discard(live)
            break
        if turn == ROUNDS:
            near = among(live.select(F.col("rep").alias("id")).distinct(), sets, label, per_cent)
            links = stored(compared(near, sets, per_cent).filter("linked").select("a", "b"), "links")
            label = merged(label, links)
            discard(live, near, links)
            break
        if turn:
            lead = live.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("pivot"), F.max("members").alias("members"))
        else:
            central = live.groupBy("rep").agg(F.sum("members").alias("central"))
            lead = live.join(central, "rep").groupBy("key").agg(F.max(F.struct("central", F.xxhash64("rep").alias("h"), "rep")).getField("rep").alias("pivot"), F.max("members").alias("members"))
        # beside the lead, others by chance: none at first, then many times as many each round
        chance = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20) < F.lit(float(GROWTH**turn - 1)) / F.col("members")
        pivots = stored(lead.union(live.filter(chance).select("key", "rep", "members")).distinct() if turn else lead, "pivots")
        parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / (16 * MEMBERS)).cast("int") - 1))
        met = live.withColumn("salt", _salt("members", "rep", 16 * MEMBERS)).join(pivots.select("key", "pivot", parts.alias("salt")), ["key", "salt"]).filter("rep <> pivot")
        balls = stored(compared(met.groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.max("members").alias("m")), sets, per_cent), "balls")
        # links to pivots come first, as what they join need not meet again
        links = stored(balls.filter("linked").select("a", "b"), "links")
        label = merged(label, links)
        hits = stored(met.join(balls.filter("settled").select(F.col("a").alias("pivot"), F.col("b").alias("rep")), ["pivot", "rep"]).select("key", "pivot", "rep"), "hits")
        near = beside(balls.join(needed(hits), "a", "left_semi"), label, per_cent)
        if not near.isEmpty():
            more = stored(compared(near, sets, per_cent).filter("linked").select("a", "b"), "links")
            label = merged(label, more)
            discard(more)
        done = hits.select("key", "rep").union(pivots.select("key", "pivot")).distinct()
        rest = stored(live.select("key", "rep").join(done, ["key", "rep"], "left_anti"), "buckets")
        discard(bucket, live, pivots, balls, hits, near, links)
        bucket = rest
    discard(bucket, sets)
    return label


def groups(docs: DataFrame, words: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n_shingles, lead) for each row: ``h`` is a hash of the text, and ``lead`` the (id, h) that leads
    the row's group: the one with the smallest id, ids before null, then the smallest h."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    sig = stored(signatures(base, words), "signatures")
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"))
    classes = sig.filter("n_shingles > 0").groupBy("n_shingles", "_s1", "_s2").agg(F.min(own).alias("lead"), F.any_value("_bands").alias("_bands"))
    # numbers of classes are fixed by being written
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        leads = classes.join(ids, classes.cid == ids.id, "left_semi").select("lead.id", "lead.h", "cid").withColumn("k", F.xxhash64("id", "h"))
        keyed = base.select(F.xxhash64("id", "h").alias("k"), "id", "h", "text")
        likely = by_bitmap(keyed, "k", id_bitmap(leads, "k"), inside=True).dropDuplicates(["k", "id", "h"])  # few other texts are shuffled
        match = (likely.k == leads.k) & likely.id.eqNullSafe(leads.id) & (likely.h == leads.h)
        return full_sets(likely.join(leads, match).select(leads.cid.alias("id"), "text"), words)

    label = linked_classes(classes, sets_of, per_cent)
    leads = classes.select("n_shingles", "_s1", "_s2", "cid", "lead")
    if label is not None:
        rooted = label.join(leads.select(F.col("cid").alias("node"), "lead"), "node")
        top = rooted.groupBy("root").agg(F.min("lead").alias("top"))
        leads = leads.join(rooted.join(top, "root").select(F.col("node").alias("cid"), "top"), "cid", "left").withColumn("lead", F.coalesce("top", "lead"))
    out = sig.join(leads.select("n_shingles", "_s1", "_s2", "lead"), ["n_shingles", "_s1", "_s2"], "left").select("id", "h", "n_shingles", "lead")
    out = stored(out, "groups")
    discard(sig, classes, label)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_shingles, component_id and kept for the id of each row.

    A set is the distinct runs of ``words`` words (lower-cased A-Z, split at ASCII white
    space); a text with fewer words is one run.  Texts without words, null texts included, are linked
    with nothing.  Two sets are linked from ``per_cent`` percent of Jaccard similarity on; at 80
    a link is missed with a probability of at most 7e-6: both ends of a permutation agree with i (i - 1) / (u (u - 1)) for
    an intersection of i and a union of u, three of them make a band, and smaller sets have more bands.

    ``component_id`` is the smallest id reachable and ``kept`` marks it.  Repeated rows (equal id and text) get
    equal results, and rows with one id and different texts their own.  Rows with a null id take part: their
    component_id is that of the others in their group, null if none of these has an id, and only then they are kept.
    """
    linked = F.col("n_shingles") > 0
    root = F.when(linked, F.col("lead.id")).otherwise(F.col("id"))
    return groups(docs, words, per_cent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of each group of near duplicates one.

    A row is known by its id and its text, so different texts under one id are rows of their own, and
    rows with a null id are members of groups like others.  The one with the smallest id stays (ids before null); of rows that
    agree in id and text, the one with the smallest values in the other columns.  Rows without words all stay.
    """
    found = groups(docs, words, per_cent, id_col, text_col).filter("n_shingles > 0")
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("h") == F.col("lead.h"))
    rows = found.groupBy("id", "h").agg(F.max(leads).alias("leads"), F.count(F.lit(1)).alias("n")).filter("NOT leads OR n > 1")
    judged = stored(rows.select(F.xxhash64("id", "h").alias("_weft_jk"), F.col("id").alias("_weft_ji"), F.col("h").alias("_weft_jh"), "leads"), "judged").withColumnRenamed("leads", "_weft_leads")
    names = docs.columns
    keyed = docs.withColumn("_weft_h", F.xxhash64(text_col)).withColumn("_weft_k", F.xxhash64(id_col, "_weft_h"))
    bits = id_bitmap(judged, "_weft_jk")  # most texts surely stay, and are not shuffled
    sure = by_bitmap(keyed, "_weft_k", bits, inside=False).select(*names)
    maybe = by_bitmap(keyed, "_weft_k", bits, inside=True)
    match = (F.col("_weft_k") == F.col("_weft_jk")) & F.col(id_col).eqNullSafe(F.col("_weft_ji")) & (F.col("_weft_h") == F.col("_weft_jh"))
    met = maybe.join(judged, match, "left")
    alone = met.filter("_weft_leads IS NULL").select(*names)
    plain = [c for c in names if isinstance(docs.schema[c].dataType, T.AtomicType)]
    many = met.filter("_weft_leads").groupBy("_weft_ji", "_weft_jh").agg(F.min_by(F.struct(*names), F.struct(*plain)).alias("_weft_row"))
    return sure.unionByName(alone).unionByName(many.select("_weft_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
