"""From stored log lines to typed per-item rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark import fields
from rankspark.functions import features
from rankspark.operators.skew import attach, top_k
from rankspark.session import materialise


def parse_log(log: DataFrame) -> DataFrame:
    """JSON text to a query struct ``q`` and an item array ``items``."""
    item = fields.raw_schema(fields.ITEM_FIELDS)
    for name in fields.ITEM_EXTRAS:
        item = item.add(name, T.StringType())
    return log.select(
        F.col("search_key").alias("search_uid"),
        *[c for c in ("page", "dt", "country_code") if c in log.columns],
        F.from_json("query_info", fields.raw_schema(fields.QUERY_FIELDS)).alias("q"),
        F.from_json("poi_info", T.ArrayType(item)).alias("items"),
    )


def keep_labelled(items: Column, threshold: int = 1) -> Column:
    """Items that carry a label of at least ``threshold`` (1 = shown, 0 = recalled too)."""
    return F.filter(items, lambda p: F.coalesce(p.p_label.cast("int") >= threshold, F.lit(False)))


def by_show_position(items: Column) -> Column:
    """Items in numeric show order, ties by their id."""
    key = lambda p: F.struct(p.p_show_pos.cast("int").alias("a"), p.p_impression_id.alias("b"), p.alias("p"))
    return F.transform(F.sort_array(F.transform(items, key)), lambda e: e.p)


def has_features(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(*features.NULL_FEATURES)


def drop_incomplete(parsed: DataFrame) -> DataFrame:
    """Drop all lines of a search in which any item lacks features."""
    parsed = materialise(parsed, "parsed")
    bad = parsed.where(F.exists("items", lambda p: ~has_features(p.p_ltrfeatures))).select("search_uid").distinct()
    return attach(parsed, bad, ["search_uid"], "left_anti")


def with_group_length(parsed: DataFrame, out: str = "group_len") -> DataFrame:
    """Items of the whole search, over all of its lines."""
    parsed = materialise(parsed, "parsed")
    return attach(parsed, parsed.groupBy("search_uid").agg(F.sum(F.size("items")).cast("int").alias(out)), ["search_uid"])


def query_rows(parsed: DataFrame) -> DataFrame:
    """One row per line with the configured query fields."""
    return parsed.select("search_uid", *fields.project_fields(fields.QUERY_FIELDS, "q"))


def item_rows(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per item with the configured query and item fields."""
    exploded = parsed.withColumn("item", F.explode("items"))
    return exploded.select(
        "search_uid", *keep,
        *fields.project_fields(fields.QUERY_FIELDS, "q"),
        *fields.project_fields(fields.ITEM_FIELDS, "item"),
        *[F.col(f"item.{c}").alias(c) for c in fields.ITEM_EXTRAS],
    )


def dedup_lines(log: DataFrame, keys: Sequence[str] = ("search_key", "page")) -> DataFrame:
    """One line per search key, the smallest by content."""
    return top_k(log, keys, [F.col("query_info"), F.col("poi_info")], 1, "_rank").drop("_rank")


def samples(log: DataFrame, threshold: int = 1) -> DataFrame:
    """Log lines to ranking samples: parse, keep labelled items in show order, drop searches
    with missing features, one row per item with its search's length and feature map.
    A search may span several lines."""
    parsed = parse_log(dedup_lines(log))
    kept = parsed.withColumn("items", by_show_position(keep_labelled(F.col("items"), threshold)))
    # One pass over the written lines says which searches stay and how long they are.
    kept = materialise(kept, "parsed")
    searches = kept.groupBy("search_uid").agg(
        F.sum(F.size("items")).cast("int").alias("group_len"),
        F.max(F.exists("items", lambda p: ~has_features(p.p_ltrfeatures))).alias("_incomplete"),
    )
    kept = attach(kept, searches.where(~F.col("_incomplete")).drop("_incomplete"), ["search_uid"])
    carried = [c for c in ("page", "dt", "country_code") if c in kept.columns]
    return item_rows(kept, [*carried, "group_len"]).select(
        "*",
        F.col("p_label").cast("int").alias("label"),
        features.parse_features(F.col("p_ltrfeatures")).alias("features"),
    )


def min_fields(lines: DataFrame, n: int, column: str = "value", sep: str = "\t") -> DataFrame:
    return lines.where(F.size(F.split(column, sep)) >= n)


def groups_with(rows: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows of the groups in which some row meets the condition."""
    found = rows.where(condition).select(key).distinct()
    return attach(rows, found, [key], "left_semi")


def task_labels(data_type: Column, label: Column) -> tuple[Column, Column]:
    """Click and order label per source; any other source is an error."""
    order = F.when(data_type == "order", label - 1)
    click = F.when(data_type.isin("click", "order"), label - 1)
    wrong = F.raise_error(F.concat(F.lit("data type must be click or order, found "), data_type)).cast("int")
    return (
        click.otherwise(wrong).alias("click_label"),
        order.when(data_type == "click", 0).otherwise(wrong).alias("order_label"),
    )


def in_country_box(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows whose coordinates lie in the box of their country."""
    return rows.join(boxes, "country").where(
        F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
        & F.col("lng").between(F.col("min_lng"), F.col("max_lng"))
    )
