"""Value dictionaries: counting, filtering, numbering, looking up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.fields import FieldSpec
from rankspark.functions import features
from rankspark.operators.skew import sorted_positions
from rankspark.session import freed_shuffles, materialise, new_path

UNKNOWN = "UNK"


@dataclass(frozen=True)
class Terms:
    """The parts that ``split`` makes of a text column, as values of a dictionary."""

    column: Column
    split: Callable[[Column], Column]


def value_counts(rows: DataFrame, values: dict[str, Sequence[Column | Terms]]) -> DataFrame:
    """(dict_key, value, cnt) over one or more columns per dictionary, in one pass over the rows.

    An array column counts each of its elements. ``Terms`` counts the distinct texts first and
    splits each of them once, with its count as weight.
    """
    def tagged(values: Column, key: str, split: int) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(key).alias("dict_key"), F.lit(split).alias("_split"), v.cast("string").alias("value")))

    entries, splits = [], {}
    for key, columns in values.items():
        for c in columns:
            if isinstance(c, Terms):
                splits[len(splits) + 1] = c.split
                entries.append(tagged(F.array(c.column.cast("string")), key, len(splits)))
                continue
            as_list = c if dict(rows.select(c.alias("x")).dtypes)["x"].startswith("array") else F.array(c.cast("string"))
            entries.append(tagged(as_list, key, 0))
    counted = (
        rows.select(F.inline(F.concat(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("dict_key", "_split", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    if not splits:
        return counted.drop("_split")
    # One split of the text for each row; whole values are their only part.
    parts = F.array("value")
    for i, split in splits.items():
        parts = F.when(F.col("_split") == i, split(F.col("value"))).otherwise(parts)
    exploded = counted.select("dict_key", F.explode(parts).alias("value"), "cnt").where(F.col("value").isNotNull())
    return exploded.groupBy("dict_key", "value").agg(F.sum("cnt").alias("cnt"))


def unknown_rows(rows: DataFrame, dict_keys: Sequence[str]) -> DataFrame:
    """One UNK entry per field, counted once per sample."""
    keys = F.explode(F.array(*[F.lit(k) for k in dict_keys])).alias("dict_key")
    return (
        rows.agg(F.count(F.lit(1)).alias("cnt"))
        .select(keys, F.lit(UNKNOWN).alias("value"), "cnt")
    )


def filter_by_count(counts: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Values above their field's threshold; fields without one are kept whole."""
    keep = F.lit(True)
    for key, low in thresholds.items():
        keep = keep & ((F.col("dict_key") != key) | (F.col("cnt") > low))
    return counts.where(keep)


def thresholds_of(specs: Sequence[FieldSpec]) -> dict[str, int]:
    return {s.dict_key: s.min_count for s in specs if s.dict_key and s.min_count is not None}


def number(counts: DataFrame) -> DataFrame:
    """Ids from 1 per field, most frequent first, then by value; 0 is left for padding.

    Entries of one value count together, such as the unknown entry and a literal ``UNK``.
    """
    counts = materialise(counts.groupBy("dict_key", "value").agg(F.sum("cnt").alias("cnt")), "counts")
    placed = sorted_positions(counts, ["dict_key"], [F.desc("cnt"), F.col("value")], "idx")
    return placed.select("dict_key", "value", F.col("idx").cast("int").alias("idx"))


#: Fields with at most so many entries are broadcast.
BROADCAST_ENTRIES = 200_000


def look_up(
    rows: DataFrame, dictionary: DataFrame, fields: dict[str, tuple[str, str]], broadcast_entries: int = BROADCAST_ENTRIES
) -> DataFrame:
    """Add an id column per field: ``fields`` maps output name -> (value column, dict_key).

    Unknown values take the field's UNK id. A user id of eight or more characters is
    hashed into a bucket instead.

    Fields with few entries are broadcast. If several have more, the rows are written and
    their values of all these fields melted into one (row, field, value) table: one narrow
    exchange meets the dictionary, one brings the ids back to the rows.
    """
    spark = rows.sparkSession
    # By field, so that each join sees the size of its own field's entries.
    path = new_path(spark, "dictionary")
    with freed_shuffles(spark):
        dictionary.select("dict_key", "value", "idx").write.partitionBy("dict_key").parquet(path)
    dictionary = spark.read.schema("value string, idx int, dict_key string").parquet(path)
    known = {
        r.dict_key: r for r in dictionary.where(F.col("dict_key").isin([k for _, k in fields.values()])).groupBy("dict_key").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("value") == UNKNOWN, F.col("idx"))).alias("unknown")).collect()}

    def id_of(found: Column, column: str, key: str) -> Column:
        text = F.col(column).cast("string")
        fallback = F.lit(known[key].unknown or 0 if key in known else 0)
        if key == "uid":
            fallback = F.when(F.length(text) >= 8, features.user_bucket(text)).otherwise(fallback)
        return F.coalesce(found, fallback).cast("int")

    large = {name: f for name, f in fields.items() if f[1] in known and known[f[1]].n > broadcast_entries}
    if len(large) < 2:
        large = {}
    out = rows
    if large:
        out = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        melted = out.select("_row", F.inline(F.array(*[
            F.struct(F.lit(i).alias("_field"), F.lit(key).alias("dict_key"), F.col(column).cast("string").alias("value"))
            for i, (column, key) in enumerate(large.values())])))
        keys = dictionary.where(F.col("dict_key").isin(list({k for _, k in large.values()})))
        met = melted.join(keys, ["dict_key", "value"])
        ids = met.groupBy("_row").agg(*[F.max(F.when(F.col("_field") == i, F.col("idx"))).alias(name) for i, name in enumerate(large)])
        out = out.join(ids, "_row", "left").drop("_row")
    empty = spark.createDataFrame([], "value string, idx int")
    for name, (column, key) in fields.items():
        if name not in large:
            own = spark.read.schema("value string, idx int").parquet(f"{path}/dict_key={key}") if key in known else empty
            ids = own.select(F.col("value").alias("_entry"), F.col("idx").alias(name))
            if key not in known or known[key].n <= broadcast_entries:
                ids = F.broadcast(ids)
            out = out.join(ids, F.col(column).cast("string") == F.col("_entry"), "left").drop("_entry")
        out = out.withColumn(name, id_of(F.col(name), column, key))
    return out
