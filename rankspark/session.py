"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.rankspark.scanPartitions", str(cores) if str(cores).isdigit() else "8")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests, the bench) gets a temporary one; on a
    cluster, where each machine has temporary folders of its own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rankspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Of each thread: lists of the paths made in open scopes, the innermost last; None keeps them.
_SCOPES = threading.local()


def _scopes() -> list[list[str] | None]:
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    return _SCOPES.open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is written to the shared folder inside is deleted at the end, but for what is
    written under :func:`kept`. Only kept tables may be read afterwards."""
    paths: list[str] = []
    scopes = _scopes()
    scopes.append(paths)
    try:
        yield
    finally:
        scopes.pop()
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def kept() -> Iterator[None]:
    """What is written inside outlives the innermost :func:`scratch`."""
    scopes = _scopes()
    scopes.append(scopes[-2] if len(scopes) > 1 else None)
    try:
        yield
    finally:
        scopes.pop()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is ever overwritten there."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _scopes() and _scopes()[-1] is not None:
        _scopes()[-1].append(path)
    return path


#: Spark's option that removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING, _FREEING_LOCK = {"writers": 0, "before": None}, threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside go when it ends, not with some later collection on the driver."""
    with _FREEING_LOCK:
        if not _FREEING["writers"]:
            _FREEING["before"] = spark.conf.get(FREE_SHUFFLES, None)
            spark.conf.set(FREE_SHUFFLES, "true")
        _FREEING["writers"] += 1
    try:
        yield
    finally:
        with _FREEING_LOCK:
            _FREEING["writers"] -= 1
            if not _FREEING["writers"]:
                if _FREEING["before"] is None:
                    spark.conf.unset(FREE_SHUFFLES)
                else:
                    spark.conf.set(FREE_SHUFFLES, _FREEING["before"])


def materialise(df: DataFrame, label: str = "table", compression: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read back.

    Later steps then see one fixed set of rows (a range shuffle samples its bounds
    anew on every run) and a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], label: str = "buckets") -> DataFrame:
    """Write once as a table bucketed and sorted by ``keys``, one file per bucket, and read back.

    Aggregates and joins by these keys over tables of as many buckets need no exchange. A bucket is
    one task's work, so keys with a large share of all rows go another way (``skew.split_hot``).
    """
    spark = df.sparkSession
    path, n = new_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    with freed_shuffles(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)
