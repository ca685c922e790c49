"""Ranking, classification and retrieval metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import vectors
from rankspark.operators.skew import running_sums, top_k

# Gain per label 0, 1, 2 and the cut-off of the ranking metric.
LABEL_GAIN = (1.0, 1.0, 3.0)
NDCG_AT = 3
MARGIN = 0.2


# ---------------------------------------------------------------- ranking


def hit_rates(rows: DataFrame, key: str, by: Sequence[str], click: Column, order: Sequence[Column]) -> DataFrame:
    """Top-1/3/5 click sums per search, as averages per ``by`` group.

    ``hit_rate`` counts every click, so a search with two clicks among its first items
    adds two; ``hit_any`` counts searches with at least one.
    """
    five = top_k(rows.withColumn("_click", click), [key], order, 5, "_rank")
    at = lambda k: F.sum(F.when(F.col("_rank") <= k, F.col("_click")).otherwise(0))
    searches = five.groupBy(key, *by).agg(*[at(k).alias(f"_h{k}") for k in (1, 3, 5)])
    return searches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"),
        *[(F.sum(f"_h{k}") / F.count(F.lit(1))).alias(f"hit_rate_{k}") for k in (1, 3, 5)],
        *[F.avg((F.col(f"_h{k}") > 0).cast("double")).alias(f"hit_any_{k}") for k in (1, 3, 5)],
    )


def ndcg(rows: DataFrame, key: str, label: str, order: Sequence[Column], at: int = NDCG_AT) -> DataFrame:
    """NDCG per search. The ideal order needs only the number of items of each label."""
    gains = F.array(*[F.lit(g) for g in LABEL_GAIN])
    gain = lambda c: F.get(gains, c)
    found = top_k(rows, [key], order, at, "_rank").groupBy(key).agg(
        F.sum(gain(F.col(label)) / F.log2(F.col("_rank") + 1)).alias("_dcg")
    )
    counts = rows.groupBy(key).agg(*[
        F.sum((F.col(label) == i).cast("int")).alias(f"_n{i}") for i in range(len(LABEL_GAIN))
    ])
    # Labels by falling gain; positions 1..at are filled in that order.
    by_gain = sorted(range(len(LABEL_GAIN)), key=lambda i: -LABEL_GAIN[i])
    ideal = F.lit(0.0)
    for rank in range(1, at + 1):
        taken, value = F.lit(0), F.lit(0.0)
        for i in by_gain:
            before, taken = taken, taken + F.col(f"_n{i}")
            value = F.when((before < rank) & (taken >= rank), LABEL_GAIN[i]).otherwise(value)
        ideal = ideal + value / F.log2(F.lit(rank + 1.0))
    return found.join(counts, key).select(key, (F.col("_dcg") / ideal).alias("ndcg"))


# ---------------------------------------------------------------- classification


def classification_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    cells = rows.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("right")),
    )))
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "right")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("right"), F.col("guessed")), ratio(F.col("right"), F.col("support"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"),
                       ratio(2 * precision * recall, precision + recall).alias("f1"), "support")


def threshold_counts(rows: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positives when everything down to each distinct score is accepted."""
    per_score = rows.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"),
    )
    return running_sums(per_score, [F.desc("threshold")], {"tp": "pos", "fp": "neg"})


def totals(rows: DataFrame, label: str) -> tuple[int, int]:
    r = rows.agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    return r.p or 0, r.n - (r.p or 0)


def pr_curve(rows: DataFrame, label: str, score: str) -> DataFrame:
    positives, _ = totals(rows, label)
    return threshold_counts(rows, label, score).select(
        "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.lit(positives)).alias("recall"),
    )


def roc_curve(rows: DataFrame, label: str, score: str) -> DataFrame:
    positives, negatives = totals(rows, label)
    return threshold_counts(rows, label, score).select(
        "threshold", (F.col("fp") / F.lit(negatives)).alias("fpr"), (F.col("tp") / F.lit(positives)).alias("tpr")
    )


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores count half."""
    positives, negatives = totals(rows, label)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return threshold_counts(rows, label, score).agg((area / F.lit(float(positives) * negatives)).alias("auc"))


def gini(rows: DataFrame, label: str, score: str) -> DataFrame:
    """1 - 2 * discordant pairs / all pairs, with tied pairs counted half."""
    return auc(rows, label, score).select((2 * F.col("auc") - 1).alias("gini"))


def gini_normalised(rows: DataFrame, label: str, score: str) -> DataFrame:
    own, best = gini(rows, label, score).first()[0], gini(rows, label, label).first()[0]
    return rows.sparkSession.createDataFrame([(own / best,)], "gini double")


# ---------------------------------------------------------------- losses


def triplet_loss(rows: DataFrame, anchor: Column, positive: Column, negative: Column, margin: float = MARGIN) -> DataFrame:
    """Mean of max(d+ - d- + margin, 0) with d = 1 - cosine."""
    far = lambda v: 1 - vectors.cosine(anchor, v)
    return rows.agg(F.avg(F.greatest(far(positive) - far(negative) + margin, F.lit(0.0))).alias("loss"))


def pairwise_loss(pairs: DataFrame, positive: Column, negative: Column, masks: dict[str, Column]) -> DataFrame:
    """Mean logistic loss of score differences per task; pairs outside a task add 0."""
    loss = F.log1p(F.exp(negative - positive))
    return pairs.agg(*[F.avg(F.when(m, loss).otherwise(0.0)).alias(name) for name, m in masks.items()])


# ---------------------------------------------------------------- retrieval


def recall_at(found: DataFrame, labelled: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """Rank histogram of the labelled item, and queries whose text a found name contains.

    ``found``: query_id, item_id, rank; ``labelled``: query_id, label_item, query.
    """
    rows = labelled.join(found, "query_id", "left").join(names, "item_id", "left")
    per_query = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("item_id") == F.col("label_item"), F.col("rank"))).alias("hit"),
        F.coalesce(F.max(F.col("name").contains(F.col("query"))), F.lit(False)).alias("inside"),
    )
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    recalled = F.col("hit").isNotNull()
    measures = {f"rank_{i}": n(F.col("hit") == i) for i in range(1, k + 1)} | {
        "recalled": n(recalled), "contained": n(F.col("inside")),
        "recalled_or_contained": n(recalled | F.col("inside")), "total": F.count(F.lit(1)),
    }
    one = per_query.agg(*[v.alias(m) for m, v in measures.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in measures])))


def click_ratios(found: DataFrame, clicked: DataFrame, tops: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Share of queries whose clicked item is among the first 1, 3, 5 and 10 retrieved."""
    hits = clicked.join(found, ["query_id", "item_id"], "left")
    share = lambda k: F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6)
    return hits.agg(F.count(F.lit(1)).alias("total"), *[share(k).alias(f"top{k}") for k in tops])
