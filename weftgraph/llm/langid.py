"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family tells the family of a text; then
one-versus-one machines among the languages of that family vote for the
language.  Features are hashed byte n-grams of the letters.  The machines are fitted
on the driver on a sample bounded by a parameter; a fixed-size matrix is broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from . import textkit as tk
from .common import crc_mod, table, with_fields

BITS = 12
SIZES = (1, 2, 3)
# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
    "semitic": ["ar", "he", "mt"],
    "sinitic": ["zh"],
    "turkic": ["tr", "az", "kk", "uz"],
}
FAMILY_OF = {lang: f for f, langs in FAMILIES.items() for lang in langs}

#: Letters lower-cased; all other ASCII becomes a space.
LETTERS = tk.LOWER.copy()
LETTERS[:128] = np.where(((np.arange(128) | 32) >= 97) & ((np.arange(128) | 32) <= 122), np.arange(128) | 32, 32)


def _counts(column: pa.Array) -> np.ndarray:
    return grams.counts(column, BITS, LETTERS, SIZES)


def _features(column: pa.Array) -> np.ndarray:
    x = np.sqrt(_counts(column))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 80) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss (accelerated gradient)."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    share = share.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step, t = np.float32(1.0 / (1.0 + 4 * c * share.max())), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v)) * share
        new = v - step * (v - np.float32(2 * c / len(y)) * ((y * slack) @ x))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + np.float32((t - 1) / t2) * (new - w), t2
    return w


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))


class FamilyThenLanguage:
    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs)
        family = np.array([FAMILY_OF.get(k, k) for k in langs])
        self.families = sorted(set(family))
        self.members = [sorted(set(y[family == f])) for f in self.families]
        self.family_w = [_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pair_w = [{(a, b): _svm(x[ok], np.where(y[ok] == m[a], 1.0, -1.0)) for a, b in combinations(range(len(m)), 2) for ok in [(y == m[a]) | (y == m[b])]} for m in self.members]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        fam = np.stack([_sigmoid(x @ w) for w in self.family_w], 1) if self.family_w else np.ones((len(x), 1))
        fam = fam / fam.sum(1, keepdims=True)
        best = fam.argmax(1)
        lang, score = np.empty(len(x), object), fam.max(1).astype(np.float64)
        for f, members in enumerate(self.members):
            at = np.flatnonzero(best == f)
            votes = np.zeros((len(at), len(members)))
            for (a, b), w in self.pair_w[f].items():
                p = _sigmoid(x[at] @ w)
                votes[:, a] += p
                votes[:, b] += 1 - p
            rounds = max(1, len(members) - 1)
            lang[at] = np.array(members, object)[votes.argmax(1)]
            if len(members) > 1:
                score[at] *= votes.max(1) / rounds
        return lang, np.clip(score, 0, 1)


def fit(docs: DataFrame, per_language: int = 600, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> FamilyThenLanguage | None:
    """Learns from about ``per_language`` rows of each language, chosen by hash of id and text; never more than twice as many in all."""
    sound = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = {r[0]: r[1] for r in sound.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    if not n:
        return None
    share = F.element_at(F.create_map(*(F.lit(v) for k, c in sorted(n.items()) for v in (k, min(1.0, per_language / c)))), F.col(lang_col))
    u = F.pmod(F.xxhash64(id_col, text_col, F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    rows = sound.filter(u < share).orderBy(u, id_col).limit(2 * per_language * len(n))
    x, kept = grams.collect_features(rows, text_col, [id_col, lang_col], _counts)
    if not len(x):
        return None
    x = np.sqrt(x)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return FamilyThenLanguage((x / np.where(norm > 0, norm, 1)).astype(np.float32), [r[1] for r in kept])


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(column: pa.Array) -> np.ndarray:
    data, off = tk.text_bytes(column)
    found = tk.per_row_sum(_ASCII_LETTER[data], off) > 0
    for i in np.flatnonzero(~found & (tk.per_row_sum(data >= 128, off) > 0)):
        found[i] = any(ch.isalpha() for ch in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, model: FamilyThenLanguage | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, and so are all
    texts if there is no model.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.names.index(text_col)

    def run(batches):
        m = sent.value
        for part in grams.row_batches(batches, text_col):
            lang, score = m.predict(_features(part.column(at))) if m else (np.full(part.num_rows, "und", object), np.zeros(part.num_rows))
            none = ~_has_letter(part.column(at))
            lang[none], score[none] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs, ("lang_pred", T.StringType()), ("score", T.DoubleType())))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
