"""Token ids from a vocabulary that Spark builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import text, tokens
from rankspark.operators import dictionary
from rankspark.operators.skew import attach
from rankspark.session import materialise

# Ids below this one are kept for padding and the special tokens.
FIRST_TOKEN_ID = 6


def tokenise(c: Column) -> Column:
    """Lower-case words, numbers and single characters, without white space and bars."""
    return F.filter(text.split_words(F.lower(c)), lambda w: (F.trim(w) != "") & (w != "|") & ~w.rlike("^\\s\\z"))


def build_vocabulary(texts: DataFrame, column: str = "text", min_count: int = 0) -> DataFrame:
    """(token, token_id), most frequent token first."""
    counts = (
        texts.select(F.explode(tokenise(F.col(column))).alias("value"))
        .groupBy(F.lit("token").alias("dict_key"), "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where(F.col("cnt") > min_count)
    )
    numbered = dictionary.number(counts)
    return materialise(numbered.select(
        F.col("value").alias("token"), (F.col("idx") + FIRST_TOKEN_ID - 1).cast("int").alias("token_id")
    ), "vocabulary")


def text_ids(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token ids of every distinct ``text``, in token order; unknown tokens get the UNK id."""
    parts = texts.distinct().select("text", F.posexplode(tokenise(F.col("text"))).alias("_pos", "token"))
    known = parts.join(vocabulary, "token", "left").withColumn("_id", F.coalesce("token_id", F.lit(tokens.UNK)))
    return known.groupBy("text").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_id"))), lambda e: e["_id"]).alias("_ids")
    )


def with_ids(rows: DataFrame, columns: dict[str, str], vocabulary: DataFrame) -> DataFrame:
    """Add id lists for text columns (text column -> output name). Every distinct text is
    encoded once, whichever columns and rows hold it; one without tokens gets an empty list."""
    texts = rows.select(F.explode(F.array(*columns)).alias("text")).where(F.col("text").isNotNull())
    ids = materialise(text_ids(texts, vocabulary), "text-ids")
    for column, out in columns.items():
        own = ids.select(F.col("text").alias(column), F.col("_ids").alias(out))
        rows = rows.join(own, column, "left").withColumn(out, F.coalesce(out, F.array().cast("array<int>")))
    return rows


def list_ids(
    rows: DataFrame, fields: dict[str, tuple[str, str, Callable[[Column], Column], int]], ids: DataFrame
) -> DataFrame:
    """Add a padded id list per field: output name -> (text column, dict_key, splitter, width).

    Every distinct text is split and looked up once, whichever rows hold it; only its first
    ``width`` values are. Fields of one dict_key share its splitter and width.
    """
    kinds = {key: (split, n) for _, key, split, n in fields.values()}
    texts = rows.select(F.explode(F.array(*[
        F.struct(F.lit(key).alias("dict_key"), F.col(c).cast("string").alias("text")) for c, key, _, _ in fields.values()])).alias("t"))
    texts = texts.select("t.*").where(F.col("text").isNotNull()).distinct()
    values = F.array().cast("array<string>")
    for key, (split, n) in kinds.items():
        values = F.when(F.col("dict_key") == key, F.slice(split(F.col("text")), 1, n)).otherwise(values)
    parts = texts.select("dict_key", "text", F.posexplode(values).alias("_pos", "value"))
    unknown = {r.dict_key: r.idx for r in ids.where((F.col("value") == dictionary.UNKNOWN) & F.col("dict_key").isin(list(kinds))).collect()}
    fallback = F.lit(0)
    for key, idx in unknown.items():
        fallback = F.when(F.col("dict_key") == key, idx).otherwise(fallback)
    met = parts.join(ids.select("dict_key", "value", "idx"), ["dict_key", "value"], "left").withColumn("_id", F.coalesce("idx", fallback))
    # A text's values are at most ``width``.
    lists = materialise(met.groupBy("dict_key", "text").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_id"))), lambda e: e["_id"]).alias("_ids")), "list-ids")
    for out, (column, key, _, n) in fields.items():
        own = lists.where(F.col("dict_key") == key).select(F.col("text").alias("_text"), F.col("_ids").alias(out))
        rows = rows.join(own, F.col(column).cast("string") == F.col("_text"), "left").drop("_text")
        rows = rows.withColumn(out, tokens.fit(F.coalesce(out, F.array().cast("array<int>")), n))
    return rows


def multi_value_ids(rows: DataFrame, key: str, values: Column, dict_key: str, ids: DataFrame, n: int, out: str) -> DataFrame:
    """Padded id list of a multi-valued field, in its own order; unknown values get UNK."""
    parts = rows.select(key, F.posexplode(values).alias("_pos", "_value"))
    coded = dictionary.look_up(parts, ids, {"_id": ("_value", dict_key)})
    lists = coded.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_id"))), lambda e: e["_id"]).alias(out)
    )
    joined = attach(rows, lists, [key], "left")
    return joined.withColumn(out, tokens.fit(F.coalesce(out, F.array().cast("array<int>")), n))
