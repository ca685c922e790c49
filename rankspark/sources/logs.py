"""The partitioned wide search log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.session import freed_shuffles

# Fixed value: a day known to be bad in the log, for ``skip_days``.
BAD_DAYS = ("20230324",)


def write_log(log: DataFrame, path: str) -> None:
    """Store the log by day and country. Rebalancing gives few files per partition and
    still splits a partition that is far larger than the others."""
    with freed_shuffles(log.sparkSession):
        log.hint("rebalance", "dt", "country_code").write.partitionBy("dt", "country_code").option("compression", "zstd").parquet(path)


def scan_log(
    spark: SparkSession,
    path: str,
    begin: str,
    end: str,
    country: str | None = None,
    skip_days: Sequence[str] = (),
) -> DataFrame:
    """Log lines of an inclusive day range (yyyy-MM-dd) and one country.

    Only the folders of the range's days are listed. ``skip_days`` (yyyyMMdd) are left out.
    """
    dt = F.col("dt").cast("date")
    first, last = date.fromisoformat(begin), date.fromisoformat(end)
    days = ",".join(str(first + timedelta(i)) for i in range((last - first).days + 1))
    try:
        log = spark.read.option("basePath", path).parquet(f"{path}/dt={{{days}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.read.parquet(path)  # no day of the range has a folder: the condition leaves nothing
    log = log.where((dt >= F.lit(begin).cast("date")) & (dt <= F.lit(end).cast("date")))
    if country is not None:
        log = log.where(F.col("country_code") == country)
    for day in skip_days:
        log = log.where(dt != F.to_date(F.lit(day), "yyyyMMdd"))
    return log


def union_countries(
    spark: SparkSession, path: str, begin: str, end: str, countries: Sequence[str], skip_days: Sequence[str] = ()
) -> DataFrame:
    """Log of several countries: one scan with a partition filter, equal to the union of
    the single-country scans."""
    return scan_log(spark, path, begin, end, skip_days=skip_days).where(F.col("country_code").isin(list(countries)))
