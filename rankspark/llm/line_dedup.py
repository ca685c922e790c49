"""Line deduplication over levelled sorted runs of line hashes.

A *run* holds the lines of a batch of documents as rows (line hash, documents holding it, largest
document), hashed into a fixed number of buckets and sorted within each. Batches arrive by
descending document id. A new batch is merge-anti-joined with the runs: a line no run has is new,
and the document that brings it is the one that keeps it; every batch adds its own run. When a
level has ``fanout`` runs they are merged into one run of the next level, so a line is rewritten
once per level. The runs are written tables: no state lives in an executor.

Defined cases: null text is one empty line; a null id counts as one document, below all others;
rows with equal ids count as one document; an empty table gives an empty result; extra columns
are kept (by ``dedup_lines``) whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import ASCII_SPACE, row_slices, table, utf8
from rankspark.operators import skew

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BATCHES = 6
FANOUT = 3
RUN_SCHEMA = "h binary, n_docs long, keeper long"


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """Digest of the stripped, lower-cased line; None if it is too short to count."""
    key = line.strip(ASCII_SPACE)
    if len(key) < least_chars:
        return None
    if len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def line_hashes(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, h): the distinct long lines of every document row."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {line_key(line, least_chars) for line in text.split(b"\n")}
                keys.discard(None)
                found += keys
                ids += [doc_id] * len(keys)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "h": pa.array(found, pa.binary())})

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return narrow.mapInArrow(hashes, "doc_id long, h binary")


class LineRuns:
    """The levels of sorted runs, each run a table in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        path = session.new_path(self.spark, "line-run")
        rows.repartition("h").sortWithinPartitions("h").write.parquet(path)
        return self.spark.read.schema(RUN_SCHEMA).parquet(path)

    def entries(self) -> DataFrame:
        """All runs merged: one row per line hash. The keeper is set by the first run that had the line."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return self._merged(union)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join the lines (doc_id, h) of a batch with the runs and add its own run.

        Lines that a run has keep that run's keeper: their entries carry only a count.
        """
        own = (
            batch.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
            .groupBy("h").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper"))
        )
        seen = None
        for run in (run for level in self.levels for run in level):
            known = run.where(F.col("keeper").isNotNull()).select("h")
            seen = known if seen is None else seen.unionByName(known)
        if seen is not None:
            own = session.materialise(own, "line-batch")
            new = own.hint("merge").join(seen.hint("merge"), "h", "left_anti")
            old = own.hint("merge").join(seen.hint("merge"), "h", "left_semi")
            own = new.unionByName(old.withColumn("keeper", F.lit(None).cast("long")))
        self._push(0, self._write(own))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            union = full[0]
            for other in full[1:]:
                union = union.unionByName(other)
            self._push(level + 1, self._write(self._merged(union)))


def repeated_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """(doc_id, hashes): for each document, the lines it loses as held by enough documents, of which it isn't the largest."""
    spark = documents.sparkSession
    bounds = documents.agg(
        F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)]).alias("q")
    ).first()["q"] or []
    # Batch 0 has the largest ids; null ids come last.
    later = sum((F.coalesce(F.col("doc_id") <= F.lit(b), F.lit(True)).cast("int") for b in sorted(set(bounds))), F.lit(0))
    path = session.new_path(spark, "line-hashes")
    line_hashes(documents, least_chars).withColumn("batch", later).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, h binary, batch int").parquet(path)

    runs = LineRuns(spark, fanout)
    for k in range(len(set(bounds)) + 1):
        runs.add(lines.where(F.col("batch") == k).select("doc_id", "h"))
    frequent = runs.entries().where(F.col("n_docs") >= least_documents).select("h", "keeper")
    lost = skew.attach(lines, frequent, ["h"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))


def dedup_lines(documents: DataFrame, **parameters: int) -> DataFrame:
    """``documents`` with the lines removed that many documents hold, all but those of the largest id.

    Adds the columns ``kept_text``, ``n_lines`` (before) and ``n_dropped``; the other columns stay.
    Parameters as for :func:`repeated_lines`.
    """
    clash = {"kept_text", "n_lines", "n_dropped"} & {c.lower() for c in documents.columns}
    if clash:
        raise ValueError(f"the result would have columns twice: {sorted(clash)}")
    least_chars = parameters.get("least_chars", LEAST_CHARS)
    lost = repeated_lines(documents, **parameters).select(
        F.col("doc_id").alias("__lost_id"), F.col("hashes").alias("__lost"))
    joined = documents.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__lost_id")), "left").drop("__lost_id")

    result = "struct<kept_text:binary,n_lines:long,n_dropped:long>"

    @F.arrow_udf(result)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, losses in batches:
            kept, n_lines, n_dropped = [], [], []
            for i in range(len(texts)):
                lines = texts[i].as_py().split(b"\n")
                gone = set(losses[i].as_py() or ())
                stay = [x for x in lines if line_key(x, least_chars) not in gone] if gone else lines
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.StructArray.from_arrays(
                [pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["kept_text", "n_lines", "n_dropped"],
            )

    return (
        joined.withColumn("__cut", cut(utf8("text"), F.col("__lost")))
        .withColumns({
            "kept_text": F.col("__cut.kept_text").cast("string"),
            "n_lines": F.col("__cut.n_lines"), "n_dropped": F.col("__cut.n_dropped"),
        }).drop("__cut", "__lost")
    )


SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {SPACE})")} AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {LEAST_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay only in the largest of these."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
