"""Text, CSV, LibSVM, JSON and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a folder and all folders below it."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def scan_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def scan_libsvm(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", n_features).load(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``idx <tab> value||field`` lines as (dict_key, value, idx)."""
    raw = spark.read.csv(path, schema="idx int, entry string", sep="\t")
    return raw.select(
        F.regexp_extract("entry", r"^(.*)\|\|([^|]*)$", 2).alias("dict_key"),
        F.regexp_extract("entry", r"^(.*)\|\|([^|]*)$", 1).alias("value"),
        "idx",
    )


def load_feature_stats(spark: SparkSession, path: str) -> DataFrame:
    """``key mean std min max`` lines; lines of another width are skipped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.size(parts) == 5)
    return lines.select(
        F.get(parts, 0).alias("key"),
        *[F.get(parts, i).cast("double").alias(n) for i, n in enumerate(("mean", "std", "low", "high"), 1)],
    )


def write_lines(df: DataFrame, path: str, *columns: Column, partitions: int | None = None, compression: str = "none") -> None:
    """Tab-separated text lines, in ``partitions`` files when given."""
    lines = df.select(F.concat_ws("\t", *columns).alias("value"))
    if partitions:
        lines = lines.repartition(partitions)
    lines.write.option("compression", compression).text(path)


def write_compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """One folder of evenly sized files instead of many small ones.

    Merging everything into a single file would send all rows through one task.
    """
    df.hint("rebalance").write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv6(df: DataFrame, path: str) -> None:
    """CSV with a header and six decimals for every fractional column."""
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.select(
        *[F.format_string("%.6f", c).alias(c) if c in fractional else F.col(c) for c in df.columns]
    ).write.csv(path, header=True)


def write_vectors(df: DataFrame, path: str, digits: int = 8) -> None:
    """JSON lines {poi_id, city_id, vector}, elements rounded."""
    df.select(
        "poi_id", "city_id", F.transform("vector", lambda x: F.round(x, digits)).alias("vector")
    ).write.json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("poi_id bigint, city_id int, vector array<double>").json(path)


def write_examples(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Typed training examples, gzip-compressed."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").option("compression", "gzip").parquet(path)


def read_examples(spark: SparkSession, path: str, widths: dict[str, int]) -> DataFrame:
    """Training examples; a list of another length than declared is an error."""
    df = spark.read.parquet(path)
    checked = {
        c: F.when(F.size(c) == n, F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{c}: expected {n} values, found "), F.size(c).cast("string")))
        )
        for c, n in widths.items()
    }
    return df.withColumns(checked)


def route_predictions(df: DataFrame, path: str) -> None:
    """Start-side and end-side predictions into separate folders (type 4 is the start)."""
    side = F.when(F.col("query_type") == 4, "start").otherwise("end")
    df.withColumn("side", side).write.partitionBy("side").parquet(path)


def typed_vectors(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Query and document vectors in one table, told apart by ``doctype``."""
    return queries.withColumn("doctype", F.lit("query")).unionByName(
        docs.withColumn("doctype", F.lit("doc"))
    )


def shuffle_rows(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """Rows in a random but repeatable order, spread evenly over the partitions."""
    order = F.xxhash64(key, F.lit(seed))
    return df.repartition(order).sortWithinPartitions(order)
