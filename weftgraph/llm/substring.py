"""Substring deduplication with suffix automata of reference shards.

A window is ``window`` consecutive words.  Its key is the smallest hash of the short
runs of words in it (a winnowing minimizer), so equal windows have equal keys
wherever they are, and consecutive windows mostly share theirs.  Keys that occur in
one document only are put aside; the passages around the others, one for each distinct
passage with the smallest id that has it, are the reference.  A key that is hot, with very many
passages, is replaced by the hashes of its windows, so its windows go to as many
places as there are different ones.

The reference is cut into shards of at most ``SHARD_WORDS`` words by key.  Each shard's suffix automaton is built
in the task that holds the shard, and the passages of all documents with its keys stream through
it, each distinct one once: the matching statistics tell for each
position with a match of ``window`` words or more the smallest id that has the match.
Words under such a match to a smaller id go.

The automata are not broadcast to all executors: together they grow with the corpus, each document would
meet each of them, and a passage can match in the shard of its key alone.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table
from .exchange import blob, bucket_slices, chunk_words, chunked, column, ids_of, in_order

#: Words of the runs that minimizers are chosen from.
RUN = 4
#: Text bytes of a chunk; a task holds about fifteen times as much.
CHUNK_BYTES = 5 << 20
#: Words of the passages in one automaton, unless those of one key are more.
SHARD_WORDS = 1 << 15
#: A key is hot from about so many passages on; a chunk tells if it has ``MANY`` of them.
HOT, MANY = 1024, 64


class SuffixAutomaton:
    """Of several word sequences, each with an owner; every state knows its least owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def add(self, words, owner) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    if owners[q] is None or owner < owners[q]:
                        owners[q] = owner
                    continue
                cur = self._clone(last, c, q)
                if owners[cur] is None or owner < owners[cur]:
                    owners[cur] = owner
                last = cur
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            owners.append(owner)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.owner.append(None)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def finish(self) -> None:
        """Least owners flow from longer matches to their suffixes."""
        link, owners = self.link, self.owner
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p, o = link[v], owners[v]
            if p > 0 and (owners[p] is None or o < owners[p]):
                owners[p] = o

    def least_owners(self, words, window: int) -> list:
        """Matching statistics: for each end of ``window`` words the least owner of those
        words, None where the automaton has no match that long."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        v, n, out = 0, 0, []
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            if to is not None:
                v, n = to, n + 1
            while length[link[v]] >= window if v else False:
                v = link[v]
                n = length[v]
            if i >= window - 1:
                out.append(owners[v] if n >= window else None)
        return out


def _passages(t: pa.Table, window: int):
    """Runs of consecutive windows with one key: (key, first word, number of windows, row)."""
    h, woff = chunk_words(t, tk.SAME)
    _, valid = ids_of(t)
    room = np.where(valid, np.maximum(np.diff(woff) - window + 1, 0), 0)
    g = tk.ngram_hashes(h, RUN)
    span = window - RUN + 1
    m, have = g, 1
    while have < span:  # sliding minimum over ``span`` run hashes
        step = min(have, span - have)
        m = np.minimum(m[: len(m) - step], m[step:]) if len(m) > step else m[:0]
        have += step
    row, nth = tk.expand(room)
    at = woff[row] + nth
    key = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return h, woff, key[first], at[first], count, row[first]


def _distinct_keys(key: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, which come with more than one id, and which with ``MANY`` passages."""
    order = np.argsort(key, kind="stable")
    k, i = key[order], ids[row[order]]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    if not len(first):
        return k, np.zeros(0, bool), np.zeros(0, bool)
    return k[first], np.minimum.reduceat(i, first) != np.maximum.reduceat(i, first), np.diff(np.append(first, len(k))) >= MANY


def _shared(t: pa.Table, answers: pa.Table, window: int, buckets: int):
    """Passages of the chunk whose key occurs in two documents of the corpus; those of hot keys by windows."""
    h, woff, key, at, count, row = _passages(t, window)
    ids, _ = ids_of(t)
    keys, _, _ = _distinct_keys(key, row, ids)
    off = bucket_slices(keys, buckets)
    flag, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for b, bits, more in zip(answers.column("bucket").to_pylist(), column(answers, "a", np.uint8), column(answers, "b", np.uint8), strict=True):
        n = off[b + 1] - off[b]
        flag[off[b] : off[b + 1]] = np.unpackbits(bits)[:n]
        hot[off[b] : off[b + 1]] = np.unpackbits(more)[:n]
    if not len(key):
        return h, woff, key, at, count, row
    place = np.searchsorted(keys, key)
    ok, split = flag[place] & ~hot[place], np.flatnonzero(flag[place] & hot[place])
    if not len(split):
        return h, woff, key[ok], at[ok], count[ok], row[ok]
    idx, nth = tk.expand(count[split])
    start = at[split][idx] + nth
    own = tk.mix(tk.ngram_hashes(h, window)[start])
    return h, woff, np.append(key[ok], own), np.append(at[ok], start), np.append(count[ok], np.ones(len(own), np.int64)), np.append(row[ok], row[split][idx])


def _distinct_passages(h, key, at, count, row, ids, window: int):
    """The chunk's distinct passages in order of key and content: index of the passage of each
    occurrence, and for each passage an occurrence and its least id."""
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, z, z, (np.zeros(0, tk.U64),) * 2
    size = count + window - 1
    off = np.concatenate([[0], np.cumsum(size)])
    idx, nth = tk.expand(size)
    w = h[at[idx] + nth]
    with np.errstate(over="ignore"):
        place = tk.mix(nth.astype(np.uint64) * tk.U64(0x9E3779B97F4A7C15) + tk.U64(1))
        d1 = np.add.reduceat(tk.mix(w ^ place), off[:-1])
        d2 = np.add.reduceat(tk.mix(w * tk.U64(0xD6E8FEB86659FD93) + place), off[:-1])
    order = np.lexsort((ids[row], d2, d1, key))
    k, x, y = key[order], d1[order], d2[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    pick = order[new]
    return which, pick, ids[row[pick]], (x[new], y[new])


def judge_shard(key, d1, d2, owner, size, words, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each passage its least owner in the shard, and which of its windows have a
    smaller owner still."""
    off = np.concatenate([[0], np.cumsum(size)])
    order = np.lexsort((owner, d2, d1, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    pick = order[new]  # distinct passages, with their least owner
    least = owner[pick]
    flags: list = [None] * len(pick)
    # runs of whole keys, of SHARD_WORDS words if there is more than one
    start = np.flatnonzero(np.append(True, key[pick][1:] != key[pick][:-1])) if len(pick) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size[pick])])
    edges, a = [0], 0
    while a < len(pick):
        b = int(np.searchsorted(total, total[a] + SHARD_WORDS, "right")) - 1
        last = int(np.searchsorted(start, b, "right")) - 1
        if start[last] > a and b < len(pick):
            b = int(start[last])
        elif b < len(pick):
            nxt = int(np.searchsorted(start, a, "right"))
            b = int(start[nxt]) if nxt < len(start) else len(pick)
        edges.append(b)
        a = b
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        texts = [words[off[p] : off[p + 1]].tolist() for p in pick[a:b].tolist()]
        sam = SuffixAutomaton()
        for text, o in zip(texts, least[a:b].tolist(), strict=True):
            sam.add(text, o)
        sam.finish()
        for i, text in zip(range(a, b), texts, strict=True):
            found = sam.least_owners(text, window)
            smaller = [x < least[i] for x in found]
            flags[i] = np.array(smaller, bool) if any(smaller) else None
    return least[which], [flags[w] for w in which.tolist()]


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """n_words, n_removed, kept_sha256 (and ``kept_text``) for the id of each row.

    Words are split at ASCII white space and compared unchanged.  A word goes if a window over
    it also starts in a text with a smaller id.  Null and empty texts have no words; texts
    shorter than a window stay whole; rows with a null id are neither cut nor
    referred to; repeated rows (equal id) don't cut each other.
    """
    base, buckets = chunked(docs, id_col, text_col, CHUNK_BYTES)
    by_chunk = lambda df: df.groupBy("chunk")

    def send_keys(t: pa.Table) -> pa.Table:
        t = in_order(t)
        _, _, key, _, _, row = _passages(t, window)
        keys, many, lots = _distinct_keys(key, row, ids_of(t)[0])
        off = bucket_slices(keys, buckets)
        full = np.flatnonzero(np.diff(off)).tolist()
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()] * len(full), pa.int32()), "keys": tk.binary_array([blob(keys[off[b] : off[b + 1]]) for b in full]), "many": tk.binary_array([blob(np.packbits(many[off[b] : off[b + 1]])) for b in full]), "lots": tk.binary_array([blob(np.packbits(lots[off[b] : off[b + 1]])) for b in full])})

    def find_shared(t: pa.Table) -> pa.Table:
        keys = column(t, "keys", np.uint64)
        bits = lambda c: np.concatenate([np.unpackbits(m)[: len(k)] for k, m in zip(keys, column(t, c, np.uint8), strict=True)])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        shared = np.bincount(inverse, weights=1.0 + bits("many")) >= 2
        hot = np.bincount(inverse, weights=np.where(bits("lots"), MANY, 1)) >= HOT
        cut = np.cumsum([len(k) for k in keys])[:-1]
        packed = lambda x: tk.binary_array([blob(np.packbits(p)) for p in np.split(x[inverse], cut)])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "kind": pa.array([0] * t.num_rows, pa.int32()), "a": packed(shared), "b": packed(hot)})

    answer = "chunk int, bucket int, kind int, a binary, b binary"
    shared = by_chunk(base).applyInArrow(send_keys, "bucket int, chunk int, keys binary, many binary, lots binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(find_shared, answer)

    def send_passages(t: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("key", "d1", "d2", "owner", "size", "words"))])
        if not t.num_rows:
            return schema.empty_table()
        t = in_order(t)
        h, _, key, at, count, row = _shared(t, answers, window, buckets)
        _, pick, owner, (d1, d2) = _distinct_passages(h, key, at, count, row, ids_of(t)[0], window)
        off = bucket_slices(key[pick], buckets)
        size = count[pick] + window - 1
        cols: dict[str, list] = {c: [] for c in schema.names}
        for b in np.flatnonzero(np.diff(off)).tolist():
            s = slice(off[b], off[b + 1])
            idx, nth = tk.expand(size[s])
            values = (b, t.column("chunk")[0].as_py(), *(blob(x) for x in (key[pick[s]], d1[s], d2[s], owner[s], size[s], h[at[pick[s]][idx] + nth])))
            for c, v in zip(schema.names, values, strict=True):
                cols[c].append(v)
        return pa.table(cols, schema=schema)

    def judge(t: pa.Table) -> pa.Table:
        cols = {c: column(t, c, k) for c, k in (("key", np.uint64), ("d1", np.uint64), ("d2", np.uint64), ("owner", np.int64), ("size", np.int64), ("words", np.uint64))}
        n = np.cumsum([0, *(len(k) for k in cols["key"])])
        least, flags = judge_shard(*(np.concatenate(cols[c]) for c in ("key", "d1", "d2", "owner", "size", "words")), window)
        size = np.concatenate(cols["size"]) - window + 1
        bits = [np.packbits(np.concatenate([np.zeros(size[i], bool) if flags[i] is None else flags[i] for i in range(a, b)])) for a, b in zip(n[:-1].tolist(), n[1:].tolist(), strict=True)]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "kind": pa.array([1] * t.num_rows, pa.int32()), "a": tk.binary_array([blob(least[a:b]) for a, b in zip(n[:-1], n[1:], strict=True)]), "b": tk.binary_array([blob(x) for x in bits])})

    passages = by_chunk(base).cogroup(by_chunk(shared)).applyInArrow(send_passages, "bucket int, chunk int, key binary, d1 binary, d2 binary, owner binary, size binary, words binary")
    judged = passages.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, answer)

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if keep_text else [])])
        if not t.num_rows:
            return schema.empty_table()
        t = in_order(t)
        kind = np.array(answers.column("kind").to_pylist(), np.int32)
        h, woff, key, at, count, row = _shared(t, answers.filter(pa.array(kind == 0)), window, buckets)
        ids, _ = ids_of(t)
        which, pick, _, _ = _distinct_passages(h, key, at, count, row, ids, window)
        off = bucket_slices(key[pick], buckets)
        woffs = np.concatenate([[0], np.cumsum(count[pick])]).astype(np.int64)
        least, smaller = np.zeros(len(pick), np.int64), np.zeros(woffs[-1], bool)
        second = answers.filter(pa.array(kind == 1))
        for b, own, bits in zip(second.column("bucket").to_pylist(), column(second, "a", np.int64), column(second, "b", np.uint8), strict=True):
            lo, hi = off[b], off[b + 1]
            least[lo:hi] = own
            smaller[woffs[lo] : woffs[hi]] = np.unpackbits(bits)[: woffs[hi] - woffs[lo]]
        diff = np.zeros(len(h) + 1, np.int64)
        occ, nth = tk.expand(count)
        gone = np.where(ids[row[occ]] > least[which[occ]], True, smaller[woffs[which[occ]] + nth]) if len(occ) else np.zeros(0, bool)
        start = at[occ[gone]] + nth[gone]
        np.add.at(diff, start, 1)
        np.add.at(diff, start + window, -1)
        stay = np.cumsum(diff[:-1]) == 0
        removed = tk.per_row_sum(~stay, woff)
        out: dict[str, list] = {c: [] for c in schema.names}
        r = 0
        for piece in t.column("text").chunks:
            data, toff = tk.text_bytes(piece)
            raw = data.tobytes()
            for i in range(len(piece)):
                words = raw[toff[i] : toff[i + 1]].split()
                kept = b" ".join(compress(words, stay[woff[r] : woff[r + 1]].tolist()) if removed[r] else words)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    out["kept_text"].append(kept.decode())
                r += 1
        out |= {"id": t.column("id"), "n_words": pa.array(np.diff(woff), pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        return pa.table(out, schema=schema)

    fields = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    done = by_chunk(base).cogroup(by_chunk(shared.unionByName(judged))).applyInArrow(cut, fields)
    return done.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
own AS (SELECT p, min(doc_id) AS least FROM win GROUP BY p),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS j FROM win JOIN own USING (p) WHERE doc_id > least),
word AS (SELECT r, unnest(generate_series(1, len(w))) AS j, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
