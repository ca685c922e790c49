"""Approximate search over compressed lists: product-quantised residuals, then exact products of few.

Every item of a :mod:`cells` index is kept, beside its vector, as the difference to the centre of its
block, cut into parts of which each is named by one byte. A query scores these codes by adding up
table entries (its products with the codebook's entries), so a list of a leaf's items is read at a
byte per part. Only the best ``depth`` items of each query have their vectors multiplied out.

How many groups a query probes and how deep its exact products go is set by the recall of a sample of
the queries, so both follow the corpus; the sample only sets these two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators import cells
from rankspark.operators.cells import floats
from rankspark.operators.skew import top_k
from rankspark.session import materialise

#: Bytes of a code, and entries of each of its codebooks.
PARTS, ENTRIES = 16, 256
#: Blocks whose residuals the codebooks are fitted on.
SAMPLE_BLOCKS = 64
#: Queries that set probes and depth, the share of their true neighbours both must hold, and the greatest depth as a multiple of k.
TUNING_QUERIES, TUNING_RECALL, DEEPEST = 512, 0.97, 40


@dataclass(frozen=True)
class Compressed:
    """``lists``: one row per leaf with its blocks, sizes, centres, ids and codes."""

    index: cells.Index
    books: np.ndarray
    lists: DataFrame


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (row, part, position), filled up with zeros."""
    step = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts * step))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, step)


def compress(index: cells.Index, parts: int = PARTS, entries: int = ENTRIES) -> Compressed:
    """Codebooks from a bounded sample of blocks, and the codes of every item."""
    width = index.width
    chosen = index.meta.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS)
    rows = index.blocks.join(F.broadcast(chosen), "block", "left_semi").orderBy("block").collect()
    residuals = np.vstack([floats(r.vectors, width) - np.frombuffer(r.centre) for r in rows]) if rows else np.zeros((1, max(width, 1)))
    cut = _cut(residuals, parts)
    books = np.zeros((parts, entries, cut.shape[2]))
    for p in range(parts):
        found = cells.cluster(cut[:, p], entries)
        # Unused entries repeat the first one.
        books[p] = np.vstack([found, np.repeat(found[:1], entries - len(found), axis=0)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for centre, vectors in zip(batch.column("centre"), batch.column("vectors"), strict=True):
                x = _cut(floats(vectors.as_py(), width) - np.frombuffer(centre.as_py()), parts)
                out.append(np.stack([cells.nearest(x[:, p], books[p]) for p in range(parts)], 1).astype(np.uint8).tobytes())
            keep = ["part", "coarse", "leaf", "block", "n", "centre", "ids"]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "codes"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        first = rows.iloc[0]
        return pd.DataFrame({
            "part": [first["part"]], "coarse": [first["coarse"]], "leaf": [first["leaf"]], "blocks": [rows["block"].tolist()],
            "ns": [rows["n"].to_numpy(np.int64).tobytes()], **{c: [b"".join(rows[c])] for c in ("centre", "ids", "codes")}})

    leaves = cells.with_leaves(index).select("block", "part", "coarse", "leaf", "n")
    one = "part string, coarse int, leaf long, block string, n int, centre binary, ids binary, codes binary"
    coded = index.blocks.join(leaves, "block").mapInArrow(encode, one)
    lists = coded.groupBy("part", "coarse", "leaf").applyInPandas(
        pack, "part string, coarse int, leaf long, blocks array<string>, ns binary, centre binary, ids binary, codes binary")
    return Compressed(index, books, materialise(lists, "code-lists"))


def candidates(rows: DataFrame, compressed: Compressed, depth: int, probes: int) -> DataFrame:
    """(query_id, item_id, block, place, nth, rank): each query's ``depth`` best items by their codes.

    ``rows``: query_id, part, vector, bound (written). ``place`` is the item's in its block, ``nth`` its group's among the query's.
    """
    index, books, width = compressed.index, compressed.books, compressed.index.width
    parts = len(books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                qids, x, nth = np.frombuffer(row["qids"], np.int64), floats(row["vectors"], width), np.frombuffer(row["bounds"])
                ns, ids = np.frombuffer(row["ns"], np.int64), np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, parts)
                of_block = np.repeat(np.arange(len(ns)), ns)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(ns) - ns, ns)
                base = x @ floats(row["centre"], width).T
                tables = np.einsum("qps,pes->qpe", _cut(x, parts), books)
                keep = min(depth, len(ids))
                for q in range(len(qids)):
                    score = base[q, of_block]
                    for p in range(parts):
                        score = score + tables[q, p, codes[:, p]]
                    some = np.argpartition(-score, keep - 1)[:keep]
                    yield pa.record_batch({
                        "query_id": pa.array(np.full(keep, qids[q])), "item_id": pa.array(ids[some]),
                        "block": pa.array([row["blocks"][b] for b in of_block[some]], pa.string()), "place": pa.array(place[some].astype(np.int32)),
                        "nth": pa.array(np.full(keep, int(nth[q]), np.int32)), "coded": pa.array(score[some])})

    asked = cells.asking(rows, index, cells.group_radii(index), probes).join(compressed.lists, ["part", "coarse"])
    found = asked.mapInArrow(scan, "query_id long, item_id long, block string, place int, nth int, coded double")
    return top_k(found, ["query_id"], [F.desc("coded"), F.col("item_id"), F.col("block"), F.col("place")], depth)


def _products(found: DataFrame, rows: DataFrame, index: cells.Index) -> DataFrame:
    """(query_id, item_id, score): exact products of the candidates, packed to the blocks they lie in."""
    width = index.width

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.array(batch.column("block").to_pylist(), object)
            ids, place = batch.column("query_id").to_numpy(), batch.column("place").to_numpy().astype(float)
            x = batch.column("vector").flatten().to_numpy().reshape(-1, width)
            order = np.argsort(block, kind="stable")
            for own in np.split(order, np.flatnonzero(block[order][1:] != block[order][:-1]) + 1):
                for s in range(0, len(own), cells.PACK_QUERIES):
                    few = own[s : s + cells.PACK_QUERIES]
                    yield cells.packs({"block": [block[few[0]]]}, [ids[few]], [x[few]], [place[few]], {"block": pa.string()})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = np.frombuffer(row["bounds"]).astype(np.int64)
                items, ids = floats(row["items"], width)[at], np.frombuffer(row["ids"], np.int64)[at]
                score = np.round((floats(row["vectors"], width) * items).sum(1), cells.SCORE_DIGITS)
                yield pa.record_batch({"query_id": pa.array(np.frombuffer(row["qids"], np.int64)), "item_id": pa.array(ids), "score": pa.array(score)})

    packed = found.join(rows.select("query_id", "vector"), "query_id").select("query_id", "block", "place", "vector").mapInArrow(
        pack, f"block string, {cells.QUERIES}")
    payload = index.blocks.select("block", "ids", F.col("vectors").alias("items"))
    return packed.join(payload, "block").mapInArrow(multiply, "query_id long, item_id long, score double")


def tuned(rows: DataFrame, compressed: Compressed, k: int, recall: float = TUNING_RECALL) -> tuple[int, int]:
    """(depth, probes): the least of both that hold ``recall`` of the true neighbours of a sample of the queries."""
    index = compressed.index
    groups = max(map(len, index.centres.values()), default=1)
    sample = materialise(rows.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING_QUERIES), "sample")
    true = cells.search(sample.select("query_id", "part", "vector"), index, k).select("query_id", "item_id")
    found = candidates(sample, compressed, DEEPEST * k, groups).select("query_id", "item_id", "nth", "rank")
    # At most TUNING_QUERIES * k rows.
    met = true.join(found, ["query_id", "item_id"], "left").select("nth", "rank").collect()
    places = [(r.nth, r["rank"]) for r in met if r.nth is not None]
    need = min(recall * len(met), len(places))
    probes = next((p for p in range(1, groups + 1) if sum(n <= p for n, _ in places) >= need), groups)
    ranks = sorted(r if n <= probes else DEEPEST * k for n, r in places)
    return max(k, ranks[int(np.ceil(need)) - 1]) if need >= 1 else k, probes


def search(queries: DataFrame, compressed: Compressed, k: int, depth: int | None = None, probes: int | None = None) -> DataFrame:
    """Approximate best ``k`` items of each query (query_id, vector and part, if the items have one): query_id, item_id, score, rank."""
    index = compressed.index
    columns = [F.col("query_id").cast("long").alias("query_id"), "vector"]
    rows = materialise(cells.keyed(queries, columns).withColumn("bound", F.lit(0.0)), "queries")
    if not index.width:
        return cells.search(queries, index, k)
    if depth is None or probes is None:
        depth, probes = tuned(rows, compressed, k)
    exact = _products(candidates(rows, compressed, depth, probes), rows, index)
    return top_k(exact, ["query_id"], [F.desc("score"), F.col("item_id")], k)
