"""The corpus pipeline: stages over ``documents``, each calling one operator of ``rankspark.llm``.

Every stage works on all rows that its predecessor kept. Rows with null ids pass like any other, and
rows that share an id but not a text are documents of their own; of rows that share both the
near-duplicate stage keeps one. Empty texts are kept by all stages (the packing gives them a piece
with the end id).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.llm import jaccard_join, line_dedup, packing, toxicity
from rankspark.operators import skew
from rankspark.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the given labels, doesn't reject as toxic."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat; all documents stay."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group that five-word shingles link at 0.8 or more."""
    rows, hashed = docs.select(*COLUMNS), F.xxhash64("text")
    # Ids that stand for several texts; of these the first by hash keeps the id as its key.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(hashed).alias("__first"), F.max(hashed).alias("__last"))
    rows = skew.attach(rows, several.where("__first <> __last").drop("__last"), ["doc_id"], "left")
    # Other rows, and those without an id, are told apart by their text, with numbers beyond all ids.
    stand_in = F.shiftrightunsigned(hashed, 2) + F.lit(1 << 62)
    stand_in = F.when(F.col("doc_id").isNotNull(), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)).otherwise(stand_in)
    own = F.col("doc_id").isNotNull() & (F.col("__first").isNull() | (F.col("__first") == hashed))
    keyed = rows.withColumn("__key", F.when(own, F.col("doc_id")).otherwise(stand_in)).drop("__first")
    found = jaccard_join.jaccard_components(keyed.select(F.col("__key").alias("doc_id"), "text"), n=5, percent=80)
    keep = found.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("__key")).distinct()
    # What shares a key shares its text.
    one = Window.partitionBy("__key").orderBy("lang", "source", "n_chars")
    return keyed.join(keep, "__key", "left_semi").withColumn("__row", F.row_number().over(one)).where("__row = 1").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all remaining documents' pieces in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage), ("line dedup", line_stage), ("n-gram jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]
#: None: a fitted model and a tokenizer aren't SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
