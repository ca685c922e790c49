"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators import dictionary
from rankspark.operators.skew import attach, group_positions, running_sums
from rankspark.session import materialise


def per_column(df: DataFrame, columns: Sequence[str], **aggregates) -> DataFrame:
    """Aggregates for many columns in one pass, as one row per column.

    ``aggregates``: output name -> function of a column giving an aggregate.
    """
    wide = df.agg(*[
        F.struct(F.lit(c).alias("column"), *[f(F.col(c)).alias(n) for n, f in aggregates.items()]).alias(f"s_{i}")
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(F.array(*[F.col(f"s_{i}") for i in range(len(columns))])))


def feature_statistics(long: DataFrame) -> DataFrame:
    """Mean, deviation, min and max per feature of (idx, value) rows."""
    return long.groupBy("idx").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, min, quartiles and max per column.

    Quartiles interpolate between the two neighbouring order statistics, found by rank
    over counts per distinct value, so memory does not grow with a column.
    """
    basic = per_column(
        df, columns, count=F.count, mean=F.avg, std=F.stddev_samp,
        min=lambda c: F.min(c.cast("double")), max=lambda c: F.max(c.cast("double")),
    )
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])))
    return basic.join(group_quantiles(long, "column", "value", (0.25, 0.5, 0.75)), "column", "left")


def group_quantiles(
    long: DataFrame, key: str, value: str, shares: Sequence[float], names: Sequence[str] | None = None
) -> DataFrame:
    """Exact interpolated quantiles per key (q25, q50, ...).

    Ranks come from running sums over the counts per distinct value, so neither memory
    nor one task grows with the rows of a key.
    """
    names = list(names or [f"q{round(s * 100)}" for s in shares])
    counts = long.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = materialise(running_sums(counts, [F.col(key), F.col("v")], {"upto": "n"}), "ranked")
    # Ranks run over all keys in order; a key's own ranks start after the keys before it.
    spans = ranked.groupBy(key).agg(
        F.min(F.col("upto") - F.col("n")).alias("_start"), F.sum("n").alias("_total")
    )
    at = attach(ranked, spans, [key]).withColumn("upto", F.col("upto") - F.col("_start"))
    picks = []
    for share, name in zip(shares, names):
        place = F.lit(share) * (F.col("_total") - 1)
        holds = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))
        low, high, part = holds(F.floor(place)), holds(F.ceil(place)), F.max(place - F.floor(place))
        picks.append((low + (high - low) * part).alias(name))
    return at.groupBy(key).agg(*picks)


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of one column as one row."""
    long = df.select(F.lit(column).alias("_column"), F.col(column).alias("_value"))
    return group_quantiles(long, "_column", "_value", shares).drop("_column")


def group_medians(long: DataFrame, key: str, value: str, out: str = "median") -> DataFrame:
    return group_quantiles(long, key, value, (0.5,), [out])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two columns, long form, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")).alias(f"s_{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.select(F.inline(F.array(*[F.col(f"s_{i}") for i in range(len(pairs))])))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, their number and share, most first."""
    return (
        per_column(
            df, df.columns,
            missing=lambda c: F.sum(c.isNull().cast("bigint")),
            share=lambda c: F.avg(c.isNull().cast("double")),
        ).where("missing > 0").orderBy(F.desc("missing"), "column")
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie.

    Counts are per distinct value first; a ``mode`` aggregate would hold every distinct
    value of a column in one task.
    """
    out = {}
    for c in columns:
        best = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = best[0] if best else None
    return out


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = {c: v for c, v in column_modes(df, columns).items() if v is not None}
    return df.fillna(modes)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls in the last bin."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, 1.5 IQR fences and the number of outliers of a column."""
    q = quantiles(df, column, (0.25, 0.5, 0.75)).first()
    spread = 1.5 * (q.q75 - q.q25)
    low, high = q.q25 - spread, q.q75 + spread
    outside = (F.col(column) < low) | (F.col(column) > high)
    return df.agg(
        F.lit(q.q25).alias("q25"), F.lit(q.q50).alias("q50"), F.lit(q.q75).alias("q75"),
        F.lit(low).alias("low_fence"), F.lit(high).alias("high_fence"),
        F.sum(outside.cast("bigint")).alias("n_outliers"),
    )


def cardinalities(df: DataFrame, columns: Sequence[str], limit: int = 50) -> DataFrame:
    """Distinct values per column and whether it stays below the limit."""
    return per_column(df, columns, n_distinct=F.count_distinct).withColumn(
        "is_small", F.col("n_distinct") < limit
    )


def dummies(train: DataFrame, df: DataFrame, columns: Sequence[str], max_levels: int = 10_000) -> DataFrame:
    """0/1 columns ``col_level`` for the levels seen in training; unseen levels give zeros.

    The levels become column names, so a column with more of them than ``max_levels`` is
    refused rather than silently cut; :func:`one_hot` takes any number.
    """
    added: dict[str, Column] = {}
    for c in columns:
        levels = [
            r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().limit(max_levels + 1).collect()
        ]
        if len(levels) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels; use one_hot")
        for v in sorted(levels, key=str):
            added[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(added)


def level_index(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dict_key, value, idx): the levels of every column numbered from 0, by column and then by level."""
    levels = train.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("dict_key"), F.col(c).cast("string").alias("value")) for c in columns]))).where(F.col("value").isNotNull()).distinct()
    order = F.array_position(F.array(*map(F.lit, columns)), F.col("dict_key"))
    placed = group_positions(levels.withColumn("_all", F.lit(0)), ["_all"], [order, F.col("value")], "idx")
    return materialise(placed.select("dict_key", "value", (F.col("idx") - 1).cast("int").alias("idx")), "levels")


def one_hot(df: DataFrame, index: DataFrame, columns: Sequence[str], out: str = "hot") -> DataFrame:
    """Add ``out``, the sorted numbers of the row's levels, for any number of levels; unseen and null ones give none."""
    names = {f"_idx_{i}": (c, c) for i, c in enumerate(columns)}
    # The look-up gives 0 for what it doesn't know, so its numbers begin at 1.
    coded = dictionary.look_up(df, index.withColumn("idx", F.col("idx") + 1), names)
    numbers = F.filter(F.array(*names), lambda i: i > 0)
    return coded.withColumn(out, F.array_sort(F.transform(numbers, lambda i: i - 1))).drop(*names)


def sparse_vectors(df: DataFrame, index: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Add a sparse 0/1 vector over all levels of the columns, for Spark ML; unseen and null levels are all zeros."""
    # One row per column.
    spans = {r.dict_key: (r.first, r.last) for r in index.groupBy("dict_key").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).collect()}
    columns = [c for c in columns if c in spans]
    names = {f"_idx_{i}": (c, c) for i, c in enumerate(columns)}
    coded = dictionary.look_up(df, index.withColumn("idx", F.col("idx") + 1), names)
    sizes = {n: spans[c][1] - spans[c][0] + 1 for n, (c, _) in names.items()}
    # Within a column the levels count from 0; what is unseen takes the number after the last, which is dropped.
    coded = coded.withColumns({
        n: F.when(F.col(n) > 0, F.col(n) - 1 - spans[c][0]).otherwise(sizes[n]).cast("double") for n, (c, _) in names.items()})
    largest = df.sparkSession.createDataFrame([tuple(float(sizes[n] - 1) for n in names)], ", ".join(f"{n} double" for n in names))
    hot = [f"{n}_hot" for n in names]
    encoder = OneHotEncoder(inputCols=list(names), outputCols=hot, dropLast=True, handleInvalid="keep").fit(largest)
    return VectorAssembler(inputCols=hot, outputCol=out).transform(encoder.transform(coded)).drop(*names, *hot)
