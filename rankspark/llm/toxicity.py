"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Labelled rows are split three ways by a hash of the id: one part finds the lexicon (words and word
beginnings that mark toxic texts, by smoothed log-odds), one fits the trees and one the calibration,
so none is judged by texts it was found on. A bounded sample of labelled rows is used
(``TRAIN_ROWS``, the smallest hashes of the id); scoring covers every row and whole texts.

Features use nothing but the text: lexicon densities and strengths, how near hits are to words for
the second person, capitals, punctuation and obfuscation rates.

Defined cases: null text is the empty text, whose features are all zero; a null id is never held
out nor labelled; labels other than 0 and 1 are ignored and, if a document has several, the highest
counts; where a part lacks one of the two labels, every score is the share of toxic labels (0
without labels); extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8

#: Most labelled rows that the fit uses.
TRAIN_ROWS = 20_000
#: Most entries of the lexicon.
LEXICON_SIZE = 4_000
#: Word beginnings that count as lexicon candidates, besides whole words.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Words around a lexicon hit in which a second-person word counts.
NEAR = 5
# Second-person words of the corpus languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su sus".split())

WORD = re.compile(r"\w+")
SHOUTED = re.compile(r"\b[^\W\d_a-z]{3,}\b")
MASKED = re.compile(r"[^\W\d_][@$*#0-9!|+]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
FEATURES = 18


def candidates(words: set[str]) -> set[str]:
    """Whole words (marked by =) and word beginnings."""
    found = {f"={w}" for w in words}
    for k in BEGINNINGS:
        found |= {w[:k] for w in words if len(w) >= k}
    return found


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """Candidates with their log-odds to be in a toxic text rather than a clean one, the surest LEXICON_SIZE.

    labelled: text and toxic.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            rows = [(w, t, k) for t in held for w, k in held[t].items()]
            held[0].clear(), held[1].clear()
            return pa.record_batch({
                "w": pa.array([r[0] for r in rows], pa.string()), "toxic": pa.array([r[1] for r in rows], pa.int32()),
                "k": pa.array([r[2] for r in rows], pa.int64())})

        for batch in row_slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[toxic].update(candidates(set(WORD.findall(text.decode().lower()))))
            if len(held[0]) + len(held[1]) > 500_000:
                yield flush()
        yield flush()

    sizes = {r["toxic"]: r["k"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("k")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counted = (
        labelled.select(utf8("text").alias("text"), F.col("toxic").cast("int")).mapInArrow(count, "w string, toxic int, k long")
        .groupBy("w").agg(F.sum(F.when(F.col("toxic") == 1, F.col("k")).otherwise(0)).alias("a"),
                          F.sum(F.when(F.col("toxic") == 0, F.col("k")).otherwise(0)).alias("b"))
    )
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (F.lit(bad) + 1.0 - a + 0.5)) - F.log(b / (F.lit(good) + 1.0 - b + 0.5))
    sure = odds / F.sqrt(1 / a + 1 / b)
    best = (
        counted.where("a >= 2").withColumns({"odds": odds, "sure": sure})
        .where((F.col("odds") > 1.5) & (F.col("sure") > 2.0)).orderBy(F.desc("sure"), "w").limit(LEXICON_SIZE).select("w", "odds"))
    return {r["w"]: r["odds"] for r in best.collect()}


def features(text: str, words_of: dict[str, float]) -> list[float]:
    """The dense features of a text; all zero for a text without characters."""
    if not text:
        return [0.0] * FEATURES
    words = WORD.findall(text.lower())
    strength: dict[str, tuple[float, float]] = {}
    for w in set(words):
        whole = words_of.get(f"={w}", 0.0)
        begins = max((words_of.get(w[:k], 0.0) for k in BEGINNINGS if len(w) >= k), default=0.0)
        if whole or begins:
            strength[w] = whole, begins
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in strength] if strength else []
    near = 0
    if hits:
        second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        at = np.array(hits)
        near = int((np.searchsorted(second, at + NEAR, "right") > np.searchsorted(second, at - NEAR)).sum()) if len(second) else 0
    whole = sorted((x for x, _ in strength.values()), reverse=True)
    begins = sorted((x for _, x in strength.values()), reverse=True)
    strong = sum(max(strength[words[i]]) > 3 for i in hits)
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = len(text)
    letters = max(1, int(data[65:91].sum() + data[97:123].sum()))
    return [
        len(hits) / n, strong / n, math.log1p(strong), float(len(strength)), math.log1p(len(hits)),
        whole[0] if whole else 0.0, whole[1] if len(whole) > 1 else 0.0,
        begins[0] if begins else 0.0, begins[1] if len(begins) > 1 else 0.0,
        near / n, float(near > 0),
        int(data[65:91].sum()) / letters, len(SHOUTED.findall(text)) / n,
        int(data[33]) / size, int(data[63]) / size, int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum()) / size,
        len(MASKED.findall(text)) / n, len(STRETCHED.findall(text)) / n,
    ]


@dataclass
class ToxicityModel:
    """The lexicon, the trees and the calibration; without trees every score is ``prior``."""

    words: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float

    def features(self, text: Column) -> Column:
        words = self.words

        @F.arrow_udf("array<double>")
        def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([features(t.as_py().decode(), words) for t in texts], pa.list_(pa.float64()))

        return rows(text)

    def score(self, documents: DataFrame) -> DataFrame:
        """``documents`` with the column ``score`` added (0 to 1)."""
        if "score" in {c.lower() for c in documents.columns}:
            raise ValueError("the result would have the column score twice")
        if self.trees is None:
            return documents.withColumn("score", F.lit(self.prior))
        names = documents.columns
        held = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), self.features(utf8("text")).alias("__dense"))
        held = held.withColumn("__features", array_to_vector("__dense")).drop("__dense")
        held = self.trees.transform(held)
        held = held.withColumn("__chance", vector_to_array("probability")[1])
        held = self.calibration.transform(held)
        return held.select("__row.*", F.least(F.greatest("__score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labelled rows (labels: doc_id, toxic) that aren't held out, at most ``train_rows`` of them."""
    key = F.xxhash64("doc_id")
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(key, "doc_id").limit(train_rows)
    )
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = session.materialise(
        texts.join(F.broadcast(sample), "doc_id").select(
            "text", "toxic", F.when(part < 4, 0).when(part < 8, 1).otherwise(2).alias("part")), "toxicity-sample")
    sizes = {(r["part"], r["toxic"]): r["k"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("k")).collect()}
    toxic, total = sum(k for (_, t), k in sizes.items() if t), sum(sizes.values())
    prior = toxic / total if total else 0.0
    if len(sizes) < 6:
        return ToxicityModel({}, None, None, prior)

    model = ToxicityModel(lexicon(rows.where("part = 0").drop("part")), None, None, prior)
    dense = session.materialise(
        rows.where("part > 0").select("part", F.col("toxic").cast("double").alias("label"), model.features(utf8("text")).alias("dense"))
        .coalesce(8), "toxicity-features").withColumn("__features", array_to_vector("dense"))
    model.trees = GBTClassifier(
        featuresCol="__features", labelCol="label",
        maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, minInstancesPerNode=3, seed=7).fit(dense.where("part = 1"))
    chance = model.trees.transform(dense.where("part = 2")).select("label", vector_to_array("probability")[1].alias("__chance"))
    model.calibration = IsotonicRegression(featuresCol="__chance", labelCol="label", predictionCol="__score").fit(chance)
    return model


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return model.score(documents.select("doc_id", "text")).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
