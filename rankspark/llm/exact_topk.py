"""Exact top-k by inner product over norm-sorted blocks of vectors.

Candidates are sorted by descending length and cut into blocks, consecutive blocks into runs. The
longest ones (a bounded head) give each query a first threshold: its k-th best score so far. A query
needs only candidates at least as long as its threshold over its own length (Cauchy-Schwarz), which is
a prefix of the runs; queries are sorted by that need and grouped with their neighbours, so a group's
prefix fits all of its queries. Within a run the thresholds rise block by block. Both sides are rotated
by the singular vectors of the corpus, so that a few leading coordinates carry most of a product: the
partial product plus the product of the residual lengths bounds it, and only pairs whose bound reaches
the threshold are multiplied out, in integers.

Groups and runs have numbers that are written with them, so results don't depend on how many
partitions an exchange has. The length of a group's prefix comes from one sort of both sides' limits.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
null ids; a repeated vec_id counts once, with the smallest of its vectors; shorter vectors are
filled with zeros; equal scores go by vec_id; a query with fewer candidates than k gets all of
them; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table
from rankspark.operators import skew

K = 20
SCALE = 64
#: Longest vectors that give the first thresholds; bounded, so it is broadcast.
HEAD = 4096
BLOCK = 2048
GROUP = 1024
#: Blocks of a run.
RUN = 8
#: Leading coordinates of the partial products.
LEADING = 16
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component; one row per id."""
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
        .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~odd)
        .select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    )


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows, filled up with zeros."""
    column = batch.column("v")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the corpus, by the sum of outer products (width x width)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch, width).astype(float)
            total += rows.T @ rows
        at = np.indices((width, width)).reshape(2, -1)
        yield pa.record_batch({"i": pa.array(at[0]), "j": pa.array(at[1]), "x": pa.array(total.reshape(-1))})

    total = np.zeros((width, width))
    for row in vectors.select("v").mapInArrow(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        total[row["i"], row["j"]] = row["x"]
    return np.linalg.svd(total)[0]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _kth(queries: np.ndarray, query_ids: np.ndarray, head: np.ndarray, head_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the head, -inf if there are fewer."""
    out = np.full(len(queries), -np.inf)
    for s in range(0, len(queries), 256):
        scores = (queries[s : s + 256] @ head.T).astype(float)
        scores[query_ids[s : s + 256, None] == head_ids] = -np.inf
        if head.shape[0] >= k:
            out[s : s + 256] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def matches(
    queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, block: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, candidate, score) of a block's pairs that reach the query's threshold, k per query at most."""
    left, right = queries @ turn, block @ turn
    rest_left = np.linalg.norm(left[:, LEADING:], axis=1)
    rest_right = np.linalg.norm(right[:, LEADING:], axis=1)
    lengths = np.linalg.norm(right, axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(queries)):
        # Lengths descend, so what can reach the threshold at all is a prefix.
        own = np.linalg.norm(left[i])
        end = len(block) if own == 0 else int(np.searchsorted(-lengths, -(least[i] - SLACK * (1 + abs(least[i]))) / own, side="right"))
        bound = right[:end, :LEADING] @ left[i, :LEADING] + rest_left[i] * rest_right[:end]
        some = np.flatnonzero((bound + SLACK * (1 + own * lengths[:end]) >= least[i]) & (ids[:end] != query_ids[i]))
        scores = block[some] @ queries[i]
        some, scores = some[scores >= least[i]], scores[scores >= least[i]]
        top = _best(scores, ids[some], k)
        found.append((np.full(len(top), i), ids[some[top]], scores[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _limits(runs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank, run) by descending top from 0, and (group, n) with the number of runs that a group needs."""
    order = [F.desc("value"), F.desc("one"), F.col("id")]
    marks = runs.select(F.col("run").alias("id"), (F.col("top") * (1 + SLACK) + SLACK).alias("value"), F.lit(1).cast("long").alias("one")).unionByName(
        groups.select(F.col("group").alias("id"), F.col("need").alias("value"), F.lit(0).cast("long").alias("one")))
    counted = session.materialise(skew.running_sums(marks, order, {"n": "one"}), "limits")
    ranks = counted.where("one = 1").select((F.col("n") - 1).alias("rank"), F.col("id").alias("run"))
    return ranks, counted.where("one = 0").select(F.col("id").alias("group"), "n")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best. Both: vec_id, v, norm of :func:`integer_vectors`."""
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    n_queries = queries.count()
    # Ids and lengths are sorted, then the head's vectors fetched.
    longest = vectors.select("vec_id", "norm").orderBy(F.desc("norm"), "vec_id").limit(HEAD)
    head_rows = vectors.join(F.broadcast(longest.select("vec_id")), "vec_id", "left_semi").toArrow().combine_chunks()
    head = head_rows.to_batches()[0] if head_rows.num_rows else None
    turn = rotation(vectors, width) if width else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast((
        _matrix(head, width) if head else np.zeros((0, width), np.int64),
        head.column("vec_id").to_numpy() if head else np.empty(0, np.int64), turn))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in row_slices(batches, block):
            if batch.num_rows:
                yield pa.record_batch({
                    "run": pa.array([part << 32 | nth // RUN], pa.int64()), "top": pa.array([batch.column("norm")[0].as_py()], pa.float64()),
                    "ids": pa.array([batch.column("vec_id").to_numpy().tobytes()], pa.binary()),
                    "rows": pa.array([_matrix(batch, width).tobytes()], pa.binary())})
                nth += 1

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_ids, _ = shared.value
        for batch in row_slices(batches, 1024):
            ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch, width)
            least, norms = _kth(rows, ids, head, head_ids, k), np.linalg.norm(rows.astype(float), axis=1)
            # A query of length 0 has a product of 0 with all: it needs every block unless 0 is too little.
            need = np.where(norms > 0, least / np.where(norms > 0, norms, 1), np.where(least > 0, np.inf, -np.inf))
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(least), pa.array(need)], ["vec_id", "v", "least", "need"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, group):
            if batch.num_rows:
                yield pa.record_batch({
                    "need": pa.array([min(batch.column("need").to_pylist())], pa.float64()),
                    "query_ids": pa.array([batch.column("vec_id").to_numpy().tobytes()], pa.binary()),
                    "queries": pa.array([_matrix(batch, width).tobytes()], pa.binary()),
                    "least": pa.array([batch.column("least").to_numpy().tobytes()], pa.binary())})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value[2]
        at, held = None, None
        for batch in row_slices(batches, 1):
            for row in batch.to_pylist():
                if at != (row["group"], row["run"]):
                    if held is not None:
                        yield held.out()
                    at, held = (row["group"], row["run"]), _Best(row, width, k)
                held.take(np.frombuffer(row["rows"], np.int64).reshape(-1, width), np.frombuffer(row["ids"], np.int64), turn)
        if held is not None:
            yield held.out()

    asked = session.materialise(queries.mapInArrow(needs, "vec_id long, v array<long>, least double, need double"), "needs")
    held = session.materialise(
        asked.repartitionByRange(max(1, -(-n_queries // group)), "need", "vec_id").sortWithinPartitions("need", "vec_id")
        .mapInArrow(groups, "need double, query_ids binary, queries binary, least binary").withColumn("group", F.monotonically_increasing_id()), "query-groups")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = session.materialise(
        vectors.repartitionByRange(n_parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
        .mapInArrow(blocks, "run long, top double, ids binary, rows binary"), "vector-blocks")
    ranks, needed = _limits(cut.groupBy("run").agg(F.max("top").alias("top")), held)
    visits = needed.where("n > 0").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rank")).join(ranks, "rank")
    # The rows of a run come to a group one after the other where Spark joins by sorting; results don't depend on it.
    pairs = visits.select("group", "run").join(held.drop("need"), "group").join(cut.drop("top"), "run")
    found = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Best:
    """The k best candidates of a group's queries so far, block by block."""

    def __init__(self, row: dict, width: int, k: int):
        self.queries, self.ids = np.frombuffer(row["queries"], np.int64).reshape(-1, width), np.frombuffer(row["query_ids"], np.int64)
        self.least, self.k = np.frombuffer(row["least"]).copy(), k
        self.found = (np.empty(0, np.int64),) * 3

    def take(self, block: np.ndarray, ids: np.ndarray, turn: np.ndarray) -> None:
        new = matches(self.queries, self.ids, self.least, block, ids, turn, self.k)
        at, candidates, scores = (np.concatenate(x) for x in zip(self.found, new, strict=True))
        order = np.lexsort((candidates, -scores, at))
        at, candidates, scores = at[order], candidates[order], scores[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        self.found = tuple(x[nth < self.k] for x in (at, candidates, scores))
        last = nth == self.k - 1
        # A query's k-th best is its threshold from now on; equal scores still count.
        np.maximum.at(self.least, at[last], scores[last].astype(float))

    def out(self) -> pa.RecordBatch:
        at, candidates, scores = self.found
        return pa.record_batch({"query_id": pa.array(self.ids[at], pa.int64()), "vec_id": pa.array(candidates, pa.int64()), "score": pa.array(scores, pa.int64())})


@query("op7_exact_topk", f"""
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= {K}
""")
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    vectors = session.materialise(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))
