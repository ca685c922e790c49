"""Group operators that stay spread out when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import materialise


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a derived table of one row per key; a null key is a key like any other.

    The derived table is written first. Spark then knows its real size and broadcasts it
    only when it is small; otherwise both join inputs are plain shuffles, which adaptive
    execution splits when a key is hot. Where ``per_key`` comes from ``rows``, pass written
    rows, so that they aren't evaluated twice.
    """
    names = {k: f"_key_{k}" for k in keys}
    table = materialise(per_key, "per-key").withColumnsRenamed(names)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return rows.join(table, same, how).drop(*names.values())


#: A key is hot from so many rows on, and from this share of all rows; so there are at most 1/share hot keys.
HOT_ROWS, HOT_SHARE = 200_000, 1e-4


def split_hot(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None) of written rows; rows without a key are in neither."""
    rows = rows.where(F.col(key).isNotNull())
    counts = materialise(rows.groupBy(key).count(), "key-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") >= max(hot_rows, int(total * HOT_SHARE))).select(key)
    if not hot.head(1):
        return rows, None
    # At most 1 / HOT_SHARE keys, as counted.
    hot = F.broadcast(hot)
    return rows.join(hot, key, "left_anti"), rows.join(hot, key, "left_semi")


def split_repeated(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key no other row has, the others or None); a null key is a key like any other."""
    repeated = materialise(rows.groupBy(key).count().where(F.col("count") > 1).select(key), "repeated")
    if not repeated.head(1):
        return rows, None
    return attach(rows, repeated, [key], "left_anti"), attach(rows, repeated, [key], "left_semi")


def split_hot_groups(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None) of written rows; a null key is a key like any other."""
    total = rows.count()
    if total < hot_rows:
        return rows, None
    names = {k: f"_key_{k}" for k in keys}
    hot = rows.groupBy(*keys).count().where(F.col("count") >= max(hot_rows, int(total * HOT_SHARE)))
    hot = materialise(hot.select(*keys), "hot-groups").withColumnsRenamed(names)
    if not hot.head(1):
        return rows, None
    # At most 1 / HOT_SHARE groups, as counted.
    hot, same = F.broadcast(hot), reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each map task passes on at most ``k`` rows of a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def sorted_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position"
) -> DataFrame:
    """1-based position within each group by a total order, without a per-group task.

    One range shuffle sorts everything by (keys, order), so a large group simply covers
    several partitions. The position is the row's place in its partition plus the
    group's rows in earlier partitions; that last table has one row per partition and
    group run only.
    """
    keys = list(keys)
    placed = materialise(
        df.orderBy(*keys, *order).withColumn("_slot", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_part", F.shiftright("_slot", 33))
    runs = placed.groupBy("_part", *keys).agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_part", *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        attach(placed, runs, ["_part", *keys])
        .withColumn(out, F.col("_slot") - F.col("_first") + F.col("_before") + 1)
        .drop("_part", "_slot", "_first", "_before")
    )


def group_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based position within each group of any size; the rows are evaluated once.

    Groups are numbered where one exchange brings their rows together, and stay there by ``keys``;
    those with a large share of all rows are numbered by one sort over several tasks.
    """
    rows = materialise(df, "rows")
    ordinary, hot = split_hot_groups(rows, keys, hot_rows) if keys else (None, rows)
    if ordinary is None:
        return sorted_positions(rows, keys, order, out)
    numbered = ordinary.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return numbered if hot is None else numbered.unionByName(sorted_positions(hot, keys, order, out))


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], inclusive: bool = True
) -> DataFrame:
    """Running totals of columns over a global order (``sums``: output name -> column).

    Sorted partitions are summed on their own and shifted by the totals of the
    partitions before them, so no task sees the whole table.
    """
    placed = materialise(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_part", F.shiftright("_slot", 33))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_s_{o}") for o in sums]
    )
    last = Window.currentRow if inclusive else -1
    within = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, last)
    # One row per sorted partition, so its size is bounded by their number.
    out = placed.join(F.broadcast(shifts), "_part")
    for o, c in sums.items():
        out = out.withColumn(o, F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_s_{o}"))
    return out.drop("_part", "_slot", *[f"_s_{o}" for o in sums])
