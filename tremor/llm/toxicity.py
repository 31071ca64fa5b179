"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of a fixed and a learned lexicon, lexicon words near a second-person word, capitals,
punctuation, obfuscated words (symbols or digits between letters, read back to letters), repeated letters, and length.

Learning: of the labelled rows whose crc32(id) modulo 5 is not 0, at most `max_rows` (a documented bound; those with the smallest
hash of their id), in three parts by another hash: one finds the learned lexicon, one fits the trees, one the isotonic
calibration. The sample's ids are bounded, so they go to every task and the documents are only scanned. Scoring reads the
text alone and shuffles nothing.

Defined cases: null text counts as empty; empty texts get the model's score for their features; null labels and ids are not
learned from; an id with several labels counts as toxic if any is; with fewer than 30 rows or one class to learn from in a
part, the score is 1 - 0.5**(lexicon words), so 0 without one; repeated rows repeat; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import append_columns, held_out, map_texts, materialize

#: A small fixed lexicon; the rest is learned from the labels.
LEXICON = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool jerk garbage filth "
    "vermin imbecile dummkopf abschaum versager arschloch connard imbécile crétin ordure basura escoria imbécil estúpido idiota"
).split()
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes tú ti vosotros".split())

_SEPARATE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"@$*!01345798#+|")] = True
_OBFUSCATED = re.compile(r"[^\W\d_]+(?:[@$*!0-9#+|]+[^\W\d_]+)+")
_READ_BACK = str.maketrans("@$!01345798|", "asioieastpgl", "*#+")
#: Bytes of the stems that are learned beside whole words.
STEMS = (5, 6, 7, 8)
N_FEATURES = 20


class Lexicon:
    """The fixed words, and the learned words and stems (which end in an asterisk)."""

    def __init__(self, learned: list[str]) -> None:
        entries = [x.encode("utf-8", "surrogateescape") for x in learned]
        self.fixed = frozenset(w.encode() for w in LEXICON)
        self.learned = frozenset(w for w in entries if not w.endswith(b"*"))
        self.stems = frozenset(w[:-1] for w in entries if w.endswith(b"*"))
        self.heads = frozenset(w[: STEMS[0]] for w in self.stems)

    def stemmed(self, w: bytes) -> bool:
        return w[: STEMS[0]] in self.heads and any(w[:n] in self.stems for n in STEMS)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = words_of(text)
    fixed, learned, heads = lexicon.fixed, lexicon.learned, lexicon.heads
    n = max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    letters = max(1, int(counts[_LETTER].sum()))
    letter = _LETTER[raw]
    hidden = int((letter[:-2] & _SYMBOL[raw[1:-1]] & letter[2:]).sum()) if len(raw) > 2 else 0
    repeats = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letter[2:]).sum()) if len(raw) > 2 else 0
    read_back = 0
    if hidden:
        read_back = sum((w := m[0].lower().translate(_READ_BACK).encode()) in fixed or w in learned for m in _OBFUSCATED.finditer(text))
    places = [i for i, w in enumerate(words) if w in fixed or w in learned]
    stems = sum(lexicon.stemmed(w) for w in words if w[: STEMS[0]] in heads) if heads else 0
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - 5) : i + 6]) for i in places)
    known = sum(words[i] in fixed for i in places)
    taught = sum(words[i] in learned for i in places)
    return [
        100.0 * known / n,
        float(np.log1p(known)),
        100.0 * taught / n,
        float(np.log1p(taught)),
        float(len({words[i] for i in places})),
        float(np.log1p(near)),
        100.0 * sum(w in SECOND_PERSON for w in words) / n,
        int(counts[65:91].sum()) / letters,
        100.0 * int(counts[33]) / n,
        100.0 * int(counts[63]) / n,
        int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / size,
        int(counts[48:58].sum()) / size,
        100.0 * hidden / n,
        float(np.log1p(read_back)),
        100.0 * repeats / n,
        float(np.log1p(len(words))),
        letters / n,
        100.0 * stems / n,
        float(np.log1p(stems)),
        float(len(places) + read_back),
    ]


class ToxicityModel:
    """Learned lexicon, trees and calibration; trees None: the fallback."""

    def __init__(self, lexicon: list[str], trees, calibration) -> None:
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def with_score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with a column __score from 0 to 1."""
        scored = docs_with_features(docs, text_col, self.lexicon)
        if self.trees is None:
            return scored.withColumn("__score", 1.0 - F.pow(F.lit(0.5), F.element_at("__features", N_FEATURES))).drop("__features")
        scored = self.trees.transform(scored.withColumn("__vector", array_to_vector("__features")))
        scored = self.calibration.transform(scored.withColumn("__p", vector_to_array("__probability")[1]))
        return scored.withColumn("__score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__calibrated")))).select(*docs.columns, "__score")


def docs_with_features(docs: DataFrame, text_col: str, lexicon: list[str]) -> DataFrame:
    words = Lexicon(lexicon)
    field = T.StructField("__features", T.ArrayType(T.DoubleType()))
    return append_columns(docs, text_col, lambda texts: {"__features": [features_of(t, words) for t in texts]}, [field])


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Text, label and part (0 to 2) of at most max_rows labelled rows, written once."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).dropna().filter(~held_out("__id", 5, 0))
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    some = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    return materialize(texts.join(F.broadcast(some), "__id").select("__id", "__text", "__label", F.pmod(F.xxhash64("__id", F.lit(7)), 3).cast("int").alias("__part")), "toxicity-sample")


def keys_of(text: str) -> set[bytes]:
    """A text's words, and the stems of its words as stem and asterisk."""
    words = set(words_of(text))
    return words | {w[:n] + b"*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(rows: DataFrame, size: int = 400) -> list[str]:
    """Words and stems far more frequent among toxic rows: in 3 of them at least and in 2 % of them, at 15 times the rate of clean rows."""
    totals = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def run(_, texts, labels):
        held = (Counter(), Counter())
        for t, label in zip(texts, labels, strict=True):
            held[int(label == 1)].update(keys_of(t))
        words = list(held[0].keys() | held[1].keys())
        return {"word": words, "toxic": [held[1][w] for w in words], "clean": [held[0][w] for w in words]}

    counted = map_texts(rows.select("__id", "__text", "__label"), run, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = (F.col("toxic") / toxic) / ((F.col("clean") + 1) / clean)
    kept = counted.filter((F.col("toxic") >= max(3.0, 0.02 * toxic)) & (rate >= 15)).orderBy(F.desc("toxic"), "word").limit(size).collect()
    return [bytes(r["word"]).decode("utf-8", "surrogateescape") for r in kept]


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    sample = _sample(docs, labels, max_rows, id_col, text_col, label_col)
    counts = {(r["__part"], r["__label"]): r["n"] for r in sample.groupBy("__part", "__label").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicon(sample.filter("__part = 0"))
    for part in (1, 2):
        if not counts.get((part, 0)) or not counts.get((part, 1)) or counts[part, 0] + counts[part, 1] < 30:
            return ToxicityModel(lexicon, None, None)
    rows = docs_with_features(sample.filter("__part > 0"), "__text", lexicon).select("__part", F.col("__label").cast("double").alias("__label"), array_to_vector("__features").alias("__vector"))
    rows = materialize(rows.repartition(4), "toxicity-features")
    learner = GBTClassifier(featuresCol="__vector", labelCol="__label", predictionCol="__class", maxDepth=3, maxIter=20, stepSize=0.3, seed=7)
    trees = learner.setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(rows.filter("__part = 1"))
    scored = trees.transform(rows.filter("__part = 2")).select("__label", vector_to_array("__probability")[1].alias("__p"))
    calibration = IsotonicRegression(featuresCol="__p", labelCol="__label", predictionCol="__calibrated").fit(scored)
    return ToxicityModel(lexicon, trees, calibration)


def toxicity_report(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """Learn on the training labels and score every row."""
    model = learn_toxicity(docs, labels, max_rows)
    scored = model.with_score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
