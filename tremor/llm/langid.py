"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, words padded with a space) in a bounded
sample of labelled rows; a document's profile is the same over its own text. The language with the smallest out-of-place
distance (the sum of rank differences; a missing n-gram costs the profile's length) wins, ties go to the smaller name.

Learning: `sample_per_lang` rows of each language at most (a documented bound), those with the smallest hash of their id among
the rows whose crc32(id) modulo 4 is not 2 and whose lang is not null. The rows' ids are ranked without their texts, each task
keeping its own smallest only; then one threshold per language selects the texts in the scan, so no text is shuffled.

Prediction never reads lang, source or the id. Defined cases: null text, or text without a letter, is `und` with score 0; with
nothing to learn from all rows are `und`; score is the margin (second - best) / second over the distances, 1 with one
language; very long texts are profiled whole; repeated rows repeat; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import held_out, map_texts

PROFILE = 300
_BITS = 20
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _LETTER


def gram_keys(text: str | None) -> np.ndarray:
    """Every n-gram occurrence of a text, as 60-bit keys (three code points modulo 2**20; a space is 0, shorter ones start with 2**20 - 1)."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[raw]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of what separates words, the first character stays
    c = np.where(is_letter, raw, 0)[keep].astype(np.int64) & ((1 << _BITS) - 1)
    c = np.pad(c, (1, int(c[-1] > 0)))  # a leading separator is never kept
    none = np.int64((1 << _BITS) - 1)
    one = c[c > 0] | none << 2 * _BITS | none << _BITS
    two = c[:-1] << _BITS | c[1:] | none << 2 * _BITS
    mid = c[1:-1] > 0
    three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[mid]
    return np.concatenate([one, two, three])


def top_grams(text: str | None, n: int = PROFILE) -> np.ndarray:
    """The n most frequent keys, most frequent first, ties to the smaller key."""
    keys, counts = np.unique(gram_keys(text), return_counts=True)
    return keys[np.lexsort((keys, -counts))[:n]]


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_per_lang: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).filter(F.col("__lang").isNotNull() & ~held_out("__id", 4, 2))
    order = F.xxhash64("__id")
    ranked = rows.select("__lang", order.alias("__h")).withColumn("__k", F.row_number().over(Window.partitionBy("__lang").orderBy("__h"))).filter(F.col("__k") <= sample_per_lang)
    limits = ranked.groupBy("__lang").agg(F.max("__h").alias("__limit")).collect()  # a row per language
    if not limits:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for r in limits for x in (r["__lang"], r["__limit"])])
    return rows.filter(order <= limit[F.col("__lang")])


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 1000, n: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its n most frequent n-gram keys, counted over the bounded sample."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(_, texts, langs):
        counts: dict[str, Counter] = {}
        for t, lang in zip(texts, langs, strict=True):
            keys, k = np.unique(gram_keys(t), return_counts=True)
            held = counts.setdefault(lang, Counter())
            for key, c in zip(keys.tolist(), k.tolist(), strict=True):
                held[key] += c
        rows = [(lang, g, c) for lang, held in counts.items() for g, c in held.items()]
        return {"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]}

    grams = map_texts(_training(docs, id_col, text_col, lang_col, sample_per_lang), run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in grams.withColumn("rank", rank).filter(F.col("rank") <= n).orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranks:
    """The n-grams of all profiles, sorted, with each one's rank in each language (n where it has none)."""

    def __init__(self, profiles: dict[str, list[int]], n: int = PROFILE) -> None:
        self.n, self.langs = n, sorted(profiles)
        self.keys = np.unique(np.concatenate([np.array(profiles[x], dtype=np.int64) for x in self.langs] or [np.empty(0, dtype=np.int64)]))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[x]), k] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        top = top_grams(text, self.n)
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, top)
        at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] != top)] = len(self.keys)
        ranks = self.ranks[at]
        place = np.arange(len(top))[:, None]
        distance = np.where(ranks < 0, self.n, np.abs(ranks - place)).sum(axis=0)
        best = int(distance.argmin())
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        second = int(np.delete(distance, best).min())
        return self.langs[best], (second - int(distance[best])) / second if second else 0.0


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", n: int = PROFILE) -> DataFrame:
    """One row per document: id, lang_pred and score."""
    ranks = Ranks(profiles, n)  # languages x n keys: a fixed size
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(ids, texts):
        found = [ranks.predict(t) for t in texts]
        return {id_col: ids, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_texts(docs.select(id_col, text_col), run, schema)


def language_report(docs: DataFrame, sample_per_lang: int = 1000) -> DataFrame:
    """Learn on the training rows and predict every row."""
    found = predict_language(docs, learn_profiles(docs, sample_per_lang=sample_per_lang))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
