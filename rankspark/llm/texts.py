"""Small helpers that the operators share: tables, text bytes, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D, as bytes.strip() and bytes.split() take it.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_slices(batches: Iterator[pa.RecordBatch], most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, so that Python objects of few texts exist at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, most_rows):
            yield batch.slice(start, most_rows)
