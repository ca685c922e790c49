"""Positive/negative pairs and triplets within search groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators.groups import first_by
from rankspark.operators.skew import attach

CLICKED = 2


def prefer_orders(click: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Per search of the click log: the order log's rows where it has any, else the click rows."""
    searched, ordered = click.select(key).distinct(), order.select(key).distinct()
    return attach(order, searched, [key], "left_semi").unionByName(attach(click, ordered, [key], "left_anti"))


def prefixed(rows: DataFrame, columns: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]


def positive_negative(
    rows: DataFrame, key: str, group_columns: Sequence[str], item_columns: Sequence[str], positive: Column
) -> DataFrame:
    """Every positive of a search with every negative of it, as one flat row each.

    The product per search is what the format consists of. It is an equality join on the
    search, so adaptive execution splits a hot search on both sides.
    """
    pos = rows.where(positive).select(key, *group_columns, *prefixed(rows, item_columns, "pos_"))
    neg = rows.where(~positive).select(key, *prefixed(rows, item_columns, "neg_"))
    return pos.join(neg, key)


def self_pairs(rows: DataFrame, key: str, group_columns: Sequence[str], item_columns: Sequence[str]) -> DataFrame:
    """Each row as its own positive and negative (test format)."""
    return rows.select(
        key, *group_columns, *prefixed(rows, item_columns, "pos_"), *prefixed(rows, item_columns, "neg_")
    )


def listing_order() -> Column:
    return F.struct("show_pos", "impression_id")


def last_clicked(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The clicked item listed last, one row per search that has one."""
    return (
        rows.where(F.col("label") == CLICKED)
        .groupBy(key)
        .agg(F.max_by(F.struct(*columns), listing_order()).alias("_pos"))
        .select(key, *[F.col(f"_pos.{c}").alias(f"pos_{c}") for c in columns])
    )


def clicked_against_rest(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The clicked item with each item not clicked; searches without a click give none."""
    rest = rows.where(F.col("label") != CLICKED)
    return attach(rest, last_clicked(rows, key, columns), [key])


def top_with_all(rows: DataFrame, key: str, columns: Sequence[str], require_positive: bool = False) -> DataFrame:
    """The item with the highest label (first listed on ties) with every item, itself included."""
    order = F.struct((-F.col("label")).alias("a"), "show_pos", "impression_id")
    top = first_by(rows, key, F.struct(*dict.fromkeys(["label", *columns])), order, "_top")
    if require_positive:
        top = top.where(F.col("_top.label") == CLICKED)
    top = top.select(key, *[F.col(f"_top.{c}").alias(f"pos_{c}") for c in columns])
    return attach(rows, top, [key])


def clicked_hard_easy(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The clicked item with, in this order: shown items not clicked, itself, items not shown.

    ``part`` is 0, 1 or 2; other clicked items take no part.
    """
    joined = attach(rows, last_clicked(rows, key, [*columns, "impression_id"]), [key])
    itself = F.col("impression_id") == F.col("pos_impression_id")
    part = F.when(itself, 1).when(F.col("show_pos") != -1, 0).otherwise(2)
    return joined.where(itself | (F.col("label") != CLICKED)).withColumn("part", part)
