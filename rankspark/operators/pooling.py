"""Averaging of vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators.skew import attach


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key; sums combine map-side."""
    return rows.groupBy(key).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(vector)
    )


def pool_fields(rows: DataFrame, key: str, vector: str, ids: str, mask: str, table: DataFrame) -> DataFrame:
    """Mean of a row's own vector and the masked sum of its looked-up field vectors.

    ``table``: field_id and a vector column of the same name as the rows' one.
    """
    used = rows.select(key, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m"))).alias("e")).where(
        "e.m = 1"
    ).select(key, F.col("e.i").alias("field_id"))
    looked_up = attach(used, table.withColumnRenamed(vector, "_v"), ["field_id"])
    sums = looked_up.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("_v")))).alias("_sum"))
    joined = rows.join(sums, key, "left")
    mean = F.zip_with(vector, "_sum", lambda a, b: (a + b) / 2)
    return joined.withColumn("pooled", F.coalesce(mean, F.col(vector))).drop("_sum")
