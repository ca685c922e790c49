"""The two-level vector index: exact search, appending, compressed lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.catalog.retrieval import sides
from rankspark.operators import cells, codes, retrieval


def frame(spark, vectors, name, first=0, part=None):
    rows = [(first + i, list(map(float, v)), None if part is None else part(first + i)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"{name} long, vector array<double>, part string").repartition(4)
    return df if part else df.drop("part")


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    """Clustered unit vectors with repeated ones, a third of all rows being one vector."""
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(12, 8)))
    x = unit(centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.15, (900, 8)))
    x[:300] = x[0]
    q = unit(np.vstack([x[rng.integers(0, 900, 60)] + rng.normal(0, 0.05, (60, 8)), rng.normal(size=(20, 8))]))
    q[:25] = q[0]
    return x, q


def brute(x, q, k, same=lambda a, b: True):
    out = {}
    for j, v in enumerate(q):
        s = np.round(x @ v, 6)
        order = sorted((i for i in range(len(x)) if same(i, j)), key=lambda i: (-s[i], i))[:k]
        out[j] = [(i, s[i]) for i in order]
    return {j: v for j, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.item_id, r.score))
    return out


@pytest.mark.parametrize("n_groups", [None, 1, 9])
def test_exact_with_hot_vectors(spark, points, n_groups):
    x, q = points
    index = cells.build(frame(spark, x, "item_id"), n_groups, block_rows=16)
    assert found(cells.search(frame(spark, q, "query_id"), index, 7)) == brute(x, q, 7)


def test_exact_within_parts(spark, points):
    x, q = points
    of = lambda i: ["a", "b", None, "c"][i % 4]
    index = cells.build(frame(spark, x, "item_id", part=of), 3, block_rows=16)
    asked = lambda j: ["a", "b", "c", "none"][j % 4]
    got = found(cells.search(frame(spark, q, "query_id", part=asked), index, 5))
    assert got == brute(x, q, 5, lambda i, j: of(i) == asked(j))


def test_fewer_items_than_k_and_none(spark, points):
    x, q = points
    index = cells.build(frame(spark, x[:3], "item_id"))
    assert found(cells.search(frame(spark, q, "query_id"), index, 7)) == brute(x[:3], q, 7)
    none = cells.build(frame(spark, x, "item_id").limit(0))
    assert cells.search(frame(spark, q, "query_id"), none, 7).collect() == []
    assert cells.search(frame(spark, q, "query_id").limit(0), index, 7).collect() == []


def test_items_are_stored_once_and_queries_travel(spark, points):
    """Blocks are bounded and hold every item once; the visits of a query stay far below all blocks."""
    x, q = points
    index = cells.build(frame(spark, x, "item_id"), 9, block_rows=16)
    stored = index.blocks.select(F.octet_length("ids").alias("b")).collect()
    assert sum(r.b for r in stored) == 8 * len(x) and max(r.b for r in stored) <= 8 * 2 * 16
    rows = frame(spark, q, "query_id").withColumns({"part": F.lit(""), "bound": F.lit(0.2)})
    directory = cells._directory(index)
    for times in (1, 3):
        many = rows
        for i in range(1, times):
            many = many.unionByName(rows.withColumn("query_id", F.col("query_id") + 1000 * i))
        packed = cells._to_blocks(cells.asking(many, index, cells.group_radii(index)).join(directory, ["part", "coarse"]), index.width, 7, False)
        visits = packed.agg(F.sum(F.octet_length("qids") / 8)).first()[0]
        assert visits < times * len(q) * len(stored) / 3
    # The plan joins packed queries with the blocks; nothing copies items per query.
    plan = cells.search(frame(spark, q, "query_id"), index, 7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queries_that_rule_nothing_out_travel_to_leaves(spark, monkeypatch):
    """Random vectors, so every block may hold a neighbour: a query is sent to few blocks, and else to whole leaves."""
    rng = np.random.default_rng(3)
    x, q = unit(rng.normal(size=(1200, 24))), unit(rng.normal(size=(40, 24)))
    sent, to_blocks = [], cells._to_blocks
    monkeypatch.setattr(cells, "_to_blocks", lambda *a: sent.append(to_blocks(*a)) or sent[-1])
    index = cells.build(frame(spark, x, "item_id"), 3, block_rows=16)
    assert found(cells.search(frame(spark, q, "query_id"), index, 7)) == brute(x, q, 7)
    assert sum(p.agg(F.sum(F.octet_length("qids") / 8)).first()[0] for p in sent) < 3 * len(q)


@pytest.mark.parametrize("leaf_bytes", [4000, 20_000])
def test_leaves_and_slices_of_any_size(spark, points, leaf_bytes):
    x, q = points
    index = cells.build(frame(spark, x, "item_id"), 3, block_rows=64)
    for k in (1, 400):
        assert found(cells.search(frame(spark, q, "query_id"), index, k, leaf_bytes)) == brute(x, q, k)


def test_append_reads_no_stored_vectors(spark, points):
    x, q = points
    index = cells.build(frame(spark, x[:500], "item_id"), 4, block_rows=16)
    fail = F.raise_error(F.lit("a stored vector was read")).cast("binary")
    guarded = cells.replace(index, blocks=index.blocks.withColumn("vectors", fail))
    grown = cells.append(guarded, frame(spark, x[500:], "item_id", 500), block_rows=16)
    assert grown.meta.agg(F.sum("n")).first()[0] == len(x)
    whole = cells.append(index, frame(spark, x[500:], "item_id", 500), block_rows=16)
    assert found(cells.search(frame(spark, q, "query_id"), whole, 7)) == brute(x, q, 7)


def test_append_splits_overgrown_groups(spark, points):
    x, q = points
    small = cells.replace(cells.build(frame(spark, x[300:420], "item_id", 300), 2, block_rows=8), group_rows=60)
    grown = cells.append(small, frame(spark, np.vstack([x[:300], x[420:]]), "item_id").withColumn(
        "item_id", F.when(F.col("item_id") < 300, F.col("item_id")).otherwise(F.col("item_id") + 120)), block_rows=8)
    assert len(grown.centres[""]) > 4
    again = cells.append(grown, frame(spark, x[:0], "item_id"))
    for index in (grown, again):
        assert found(cells.search(frame(spark, q, "query_id"), index, 7)) == brute(x, q, 7)
    first = cells.append(cells.build(frame(spark, x[:0], "item_id")), frame(spark, x, "item_id"))
    assert found(cells.search(frame(spark, q, "query_id"), first, 7)) == brute(x, q, 7)


@pytest.mark.parametrize("n_groups", [None, 6])
def test_compressed_recall(spark, points, n_groups):
    x, q = points
    x = x[300:]
    compressed = codes.compress(cells.build(frame(spark, x, "item_id"), n_groups, block_rows=16), parts=4, entries=16)
    rows = frame(spark, q, "query_id").withColumns({"part": F.lit(""), "bound": F.lit(0.0)})
    depth, probes = codes.tuned(rows, compressed, 5)
    assert depth < len(x) / 4
    got, want = found(codes.search(frame(spark, q, "query_id"), compressed, 5)), brute(x, q, 5)
    assert sum(len(set(got[j]) & set(want[j])) for j in want) >= 0.9 * 5 * len(q)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_registered_search(spark, sf):
    """knn_lsh at its own settings: recall at 10, and the share of vectors multiplied out."""
    queries, items = sides(spark, f"/root/testdata/{sf}")
    index = cells.build(items.select("item_id", "vector"))
    compressed = codes.compress(index)
    rows = queries.select("query_id", F.lit("").alias("part"), "vector", F.lit(0.0).alias("bound"))
    depth, probes = codes.tuned(rows, compressed, 10)
    assert depth < items.count() / 4
    want, got = found(cells.search(queries.select("query_id", "vector"), index, 10)), found(retrieval.compressed_top_k(queries, items, 10))
    recall = sum(len(set(got[j]) & set(want[j])) for j in want) / sum(map(len, want.values()))
    print(sf, "depth", depth, "probes", probes, "recall", recall)
    assert recall >= 0.9
