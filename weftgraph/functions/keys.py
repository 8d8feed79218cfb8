"""Keys of identity and other scalar expressions.

The label keys are not interchangeable: ``id_key`` names nodes, ``dedup_key`` merges
them, ``search_key`` finds them, ``call_key`` resolves calls and ``stub_key``
resolves stubs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _folded(c: Column, unicode: bool) -> Column:
    return nfkc_casefold(c) if unicode else F.lower(c)


def id_key(c: Column, unicode: bool = False) -> Column:
    """Runs of other than word characters become one ``_``; trimmed; lower case.

    ``unicode`` folds by NFKC and case in a Python function; without it the key is
    JVM-only and exact for text without compatibility characters.
    """
    words = F.regexp_replace(_folded(c, unicode), r"(?U)[^\w]+", "_")
    return F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_|_$", "")


def dedup_key(c: Column, unicode: bool = False) -> Column:
    return F.trim(F.regexp_replace(_folded(c, unicode), r"(?U)[\W_]+", " "))


def search_key(c: Column, unicode: bool = False) -> Column:
    return F.lower(strip_accents(c) if unicode else c)


def call_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[()]+|[()]+$", ""), r"^\.+", ""))


def stub_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", ""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Lower-cased file suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def file_stem(path: Column) -> Column:
    """Parent directory and stem joined by a dot; the bare stem at the root."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.when(parent == "", stem).otherwise(F.concat_ws(".", parent, stem))


def normal_path(path: Column, root: str | None = None) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        prefix = root.rstrip("/") + "/"
        p = F.when(p.startswith(prefix), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p)
    return p


def lookup(c: Column, groups: dict[str, list[str]]) -> Column:
    """The group that lists the value; null if none does."""
    out = None
    for name, values in groups.items():
        out = F.when(c.isin(values), name) if out is None else out.when(c.isin(values), name)
    return out


def half_even_percent(part: Column, whole: Column) -> Column:
    return F.bround(part * 100.0 / F.greatest(whole, F.lit(1)), 0).cast("long")


def _jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; the prefix bonus applies above a Jaro similarity of 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def _damerau(a: str, b: str) -> int:
    """Distance with adjacent transpositions, edits of a transposed pair allowed."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, at = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][at] + (i - k - 1) + 1 + (j - at - 1))
        last[x] = i
    return d[len(a) + 1][len(b) + 1]


@F.pandas_udf(T.IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _damerau(x, y) for x, y in zip(a, b, strict=True)])
