"""Sampling and splitting by a hash of the row key: repeatable on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators.skew import attach, sorted_positions
from rankspark.session import materialise

# Sampling seed, fold seed, oversampling of clicks, size from which strata are cut.
SEED = 12357
FOLD_SEED = 2016
CLICK_FACTOR = 1.8
SMALL_STRATUM = 1000


def hash_text(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))


def unit_hash(key: Column, seed: int) -> Column:
    """Number in [0, 1) from the first 32 hash bits."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def sample(df: DataFrame, key: Column, n: int | None, total: int | None = None, factor: float = 1.0, seed: int = SEED) -> DataFrame:
    """About ``n`` rows without replacement; ``None`` keeps all. ``total`` saves the count."""
    if n is None:
        return df
    total = df.count() if total is None else total
    fraction = min(1.0, factor * n / max(total, 1))
    return df.where(unit_hash(key, seed) < fraction)


def stratified_quarter(df: DataFrame, stratum: str, key: Column, keep_whole: str, seed: int = SEED) -> DataFrame:
    """Small strata and the default one whole, of every other one a quarter in hash order."""
    df = materialise(df, "rows")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(df, sizes, [stratum])
    whole = (F.col("_n") < SMALL_STRATUM) | F.coalesce(F.col(stratum) == keep_whole, F.lit(False))
    cut = sorted_positions(
        sized.where(~whole).withColumn("_h", hash_text(key, seed)), [stratum], [F.col("_h"), key], "_rn"
    ).where(F.col("_rn") <= F.floor(F.col("_n") / 4))
    return sized.where(whole).drop("_n").unionByName(cut.drop("_n", "_h", "_rn"))


def train_test(key: Column, test_share: float = 0.25, seed: int = SEED) -> Column:
    """``test`` or ``train`` per row."""
    return F.when(unit_hash(key, seed) < test_share, "test").otherwise("train")


def stratified_folds(df: DataFrame, label: str, key: Column, k: int = 5, seed: int = FOLD_SEED) -> DataFrame:
    """Shuffled fold number 0..k-1 with every label spread evenly over the folds."""
    placed = sorted_positions(df.withColumn("_h", hash_text(key, seed)), [label], [F.col("_h"), key], "_rn")
    return placed.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_h", "_rn")
