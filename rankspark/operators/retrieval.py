"""Vector retrieval: exact and approximate top-k, routing, negatives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import vectors as vec
from rankspark.operators import cells, codes
from rankspark.operators.skew import attach, top_k
from rankspark.session import materialise

# Vectors per side of one scoring block; a block and its score matrix stay small.
BLOCK_ROWS = 20_000
SCORE_DIGITS = 6
# Queries that set the number of probed cells, and the share of their true neighbours these must hold.
PROBE_SAMPLE = 512
PROBE_RECALL = 0.95


def route_to_city(queries: DataFrame, items: DataFrame, default_city: int) -> DataFrame:
    """City to search for each query: its own when that has items, else the default."""
    known = items.select(F.col("city_id")).distinct().withColumn("_known", F.lit(True))
    routed = attach(queries, known, ["city_id"], "left")
    return routed.withColumn(
        "search_city", F.when(F.col("_known"), F.col("city_id")).otherwise(default_city)
    ).drop("_known")


def exclude(candidates: DataFrame, clicked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates without the clicked items."""
    return attach(candidates, clicked.select(*keys).distinct(), keys, "left_anti")


def slice_part(rank: Column) -> Column:
    """0 for the hard-negative ranks 7-12 (0-based), 1 for the rest."""
    return F.when(rank.between(7, 12), 0).otherwise(1)


def _block_top_k(k: int):
    """Scoring of one block of queries against one block of items: only the best ``k``
    per query leave the task."""

    def score(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": "int64", "item_id": "int64", "score": "float64"}
        if queries.empty or items.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})
        items = items.sort_values("item_id", kind="stable")
        ids = items["item_id"].to_numpy()
        m = np.vstack(items["vector"].to_numpy())
        keep = min(k, len(ids))
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            scores = np.round(np.vstack(part["vector"].to_numpy()) @ m.T, SCORE_DIGITS)
            floor = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
            for q, row, low in zip(part["query_id"].to_numpy(), scores, floor):
                candidates = np.flatnonzero(row >= low)
                best = candidates[np.argsort(-row[candidates], kind="stable")[:keep]]
                out.append(pd.DataFrame({"query_id": q, "item_id": ids[best], "score": row[best]}))
        return pd.concat(out, ignore_index=True)

    return score


def _blocks(df: DataFrame, cell: str, key: str, block_rows: int, mine: str, sizes: DataFrame, other: str) -> DataFrame:
    """Give each row its block in the cell, and one copy per block of the other side."""
    placed = df.join(sizes, cell).withColumn(mine, F.pmod(F.xxhash64(key), F.col(f"n_{mine}")))
    return placed.withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1))
    ).drop(f"n_{mine}", f"n_{other}")


def cell_top_k(queries: DataFrame, items: DataFrame, k: int, block_rows: int = cells.BLOCK_ROWS) -> DataFrame:
    """Best ``k`` items per query by inner product among the items of the query's cell.

    ``queries``: query_id, cell, vector; ``items``: item_id, cell, vector (of length 1 at most).
    Each cell has its own groups and blocks (:mod:`cells`); the items stay in their block.
    """
    index = cells.build(items.select("item_id", F.col("cell").alias("part"), "vector"), block_rows=block_rows)
    return cells.search(queries.select("query_id", F.col("cell").alias("part"), "vector"), index, k)


def block_top_k(queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best ``k`` items per query among the items of the query's cells, of which it may have several.

    A cell is cut into blocks of bounded size on both sides, so a cell with most of the corpus or most
    of the queries is spread over many tasks, and no pair but the best leaves a task.
    """
    count = lambda df, name: df.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("bigint").alias(name)
    )
    sizes = materialise(count(queries, "n_q_block").join(count(items, "n_i_block"), "cell"), "sizes")
    q = _blocks(queries, "cell", "query_id", block_rows, "q_block", sizes, "i_block")
    i = _blocks(items, "cell", "item_id", block_rows, "i_block", sizes, "q_block")
    keys = ["cell", "q_block", "i_block"]
    best = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(
        _block_top_k(k), "query_id bigint, item_id bigint, score double"
    )
    return top_k(best, ["query_id"], [F.desc("score"), F.col("item_id")], k)


def unit(df: DataFrame, key: str, name: str, vector: str = "embedding", *keep: Column) -> DataFrame:
    """Rows reduced to an id and a unit vector."""
    return df.select(F.col(key).alias(name), *keep, vec.l2_normalise(F.col(vector)).alias("vector"))


def city_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Top-k within the query's ``search_city``; items carry ``city_id``."""
    q = queries.select("query_id", F.col("search_city").alias("cell"), "vector")
    i = items.select("item_id", F.col("city_id").alias("cell"), "vector")
    return cell_top_k(q, i, k)


def _distances(vector: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Euclidean distances to a fixed, small set of centres, a batch of vectors at a time."""
    c = np.asarray(centres)

    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy())
        square = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        return pd.Series(list(np.sqrt(np.maximum(square, 0.0))))

    return distances(vector)


def fit_cells(items: DataFrame, n_cells: int, seed: int = 7) -> list[list[float]]:
    """Centres of ``n_cells`` clusters of the corpus."""
    model = KMeans(k=n_cells, seed=seed, maxIter=5, featuresCol="f").fit(
        items.select(array_to_vector("vector").alias("f"))
    )
    return [list(map(float, c)) for c in model.clusterCenters()]


def into_cells(items: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Items with their nearest cell and the distance to its centre."""
    far = F.transform("_d", lambda x, i: F.struct(x.alias("d"), i.alias("c")))
    return (
        items.withColumn("_d", _distances(F.col("vector"), centres))
        .withColumn("_near", F.array_min(far))
        .select("*", F.col("_near.c").alias("cell"), F.col("_near.d").alias("centre_distance"))
        .drop("_near", "_d")
    )


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, n_cells: int | None = None) -> DataFrame:
    """Exact top-k by cosine over the whole corpus of unit vectors, by an index of two levels (:mod:`cells`).

    ``n_cells`` sets the number of groups; left out, it follows from the number of items.
    """
    return cells.search(queries.select("query_id", "vector"), cells.build(items.select("item_id", "vector"), n_cells), k)


def needed_probes(queries: DataFrame, items: DataFrame, k: int, n_cells: int, recall: float) -> int:
    """Fewest nearest cells that hold the ``recall`` of the true top-k of a sample of the queries.

    ``queries``: query_id, vector, order (their cells, nearest first); ``items``: item_id, cell, vector.
    The sample only sets the number; it searches all cells.
    """
    sample = materialise(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBE_SAMPLE), "sample")
    every = sample.select("query_id", "vector", F.explode("order").alias("cell"))
    true = block_top_k(every, items, k).select("query_id", "item_id")
    # At most PROBE_SAMPLE * k rows, and PROBE_SAMPLE of the sample.
    cells = items.select("item_id", "cell").join(F.broadcast(true), "item_id")
    nth = F.array_position("order", F.col("cell")).cast("int")
    placed = cells.join(F.broadcast(sample.select("query_id", "order")), "query_id").groupBy(nth.alias("nth")).count().collect()
    held = {r["nth"]: r["count"] for r in placed}
    total = sum(held.values())
    return next((p for p in range(1, n_cells) if total and sum(held.get(i, 0) for i in range(1, p + 1)) >= recall * total), n_cells)


def probe_top_k(
    queries: DataFrame, items: DataFrame, k: int, n_cells: int = 16, n_probes: int | None = None, recall: float = PROBE_RECALL
) -> DataFrame:
    """Approximate top-k: each query searches its ``n_probes`` nearest cells only.

    Without a number of probes it is the fewest that reach ``recall`` on a sample of the queries, up
    to all cells.
    """
    centres = fit_cells(items, n_cells)
    placed = materialise(into_cells(items, centres).select("item_id", "cell", "vector"), "cells")
    order = F.array_sort(F.transform("d", lambda x, c: F.struct(x.alias("d"), c.alias("c"))))
    q = queries.withColumn("d", _distances(F.col("vector"), centres)).select(
        "query_id", "vector", F.transform(order, lambda e: e.c).alias("order")
    )
    if n_probes is None:
        q = materialise(q, "queries")
        n_probes = needed_probes(q, placed, k, len(centres), recall)
    near = q.select("query_id", "vector", F.explode(F.slice("order", 1, n_probes)).alias("cell"))
    return block_top_k(near, placed, k)


def hard_negatives(queries: DataFrame, items: DataFrame, clicked: DataFrame, k: int) -> DataFrame:
    """Retrieved items other than the clicked one, with the hard ranks first.

    ``clicked``: query_id, item_id. Ranks are counted again without the clicked item.
    """
    found = city_top_k(queries, items, k + 1).select("query_id", "item_id", "score")
    left = exclude(found, clicked, ["query_id", "item_id"])
    ranked = top_k(left, ["query_id"], [F.desc("score"), F.col("item_id")], k)
    rank = F.col("rank") - 1
    return ranked.select("query_id", "item_id", "score", rank.alias("rank"), slice_part(rank).alias("part"))


def compressed_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Approximate top-k by compressed lists (:mod:`codes`), probes and depth set by a sample of the queries."""
    compressed = codes.compress(cells.build(items.select("item_id", "vector")))
    return codes.search(queries.select("query_id", "vector"), compressed, k)


def append_corpus(items: DataFrame, path: str, new: DataFrame) -> DataFrame:
    """Add items to a stored corpus and return the whole of it."""
    new.write.mode("append").parquet(path)
    return items.sparkSession.read.parquet(path)
