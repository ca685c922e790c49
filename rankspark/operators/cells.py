"""Vector index of two levels: groups of cells, and cells that are blocks of bounded size.

Both levels have a centre and a radius, so the triangle inequality rules out whole groups first and
single blocks then. The number of blocks grows with the corpus; a block holds a few hundred vectors
and is stored once. What travels are the queries, packed: first to their nearest blocks, which bound the
distance of their k-th neighbour, then once to each part of a group (a *leaf*, of LEAF_BYTES) that
the bound allows. A task holds one leaf and one slice of its queries, both of bounded size, and
passes on ``k`` items a query at most, so where nothing can be ruled out, as among random vectors, the
rows shuffled are queries x leaves, not queries x blocks. Hot leaves get many slices.

An index is two tables and a few centres. ``blocks`` is the payload. ``meta`` (centre, radius, size and group of each block) is narrow. Group centres exist for
parts of the corpus (cities, say) with more than ``group_rows`` items; ``group_rows`` grows with the
corpus so that there are at most ``MOST_GROUPS`` of these, which is what is broadcast.

New items form blocks of their own in the groups that exist (:func:`append`): no stored vector is
read. A group that has outgrown its size is split by the centres of its blocks, which only changes
``meta``.

Vectors have a length of at most 1; ``part`` is compared as text, and rows without one take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators.skew import attach, top_k
from rankspark.session import materialise

#: Vectors of a block, items of a group, and groups of all large parts together, at most about.
BLOCK_ROWS, GROUP_ROWS, MOST_GROUPS = 256, 20_000, 4_096
#: Sampled items per group that its centres are fitted on.
SAMPLE_ROWS = 32
#: Queries that travel in one pack, and blocks that one row of the directory lists.
PACK_QUERIES, LEAF_BLOCKS = 256, 512
#: Vectors that a task of the exact search holds at once, of items and of queries each, about.
LEAF_BYTES = 16 << 20
SCORE_DIGITS = 6
#: Covers the rounding of scores in squared distances.
SLACK = 4e-6

BLOCK = "part string, coarse int, n int, radius double, centre binary, ids binary, vectors binary"


@dataclass(frozen=True)
class Index:
    """``blocks``: block, centre, ids, vectors; ``meta``: block, part, coarse, n, radius, centre."""

    blocks: DataFrame
    meta: DataFrame
    width: int
    #: Group centres of the large parts.
    centres: dict[str, np.ndarray] = field(default_factory=dict)
    group_rows: int = GROUP_ROWS
    generation: int = 0


def floats(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre, some rows at a time."""
    step = max(1, 4_000_000 // max(len(centres), 1))
    parts = [squares(x[s : s + step], centres).argmin(1) for s in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def cluster(x: np.ndarray, k: int, rounds: int = 5, weights: np.ndarray | None = None) -> np.ndarray:
    """Centres of ``k`` clusters of the rows at hand, the same for the same rows."""
    x = x[np.lexsort(x.T[:4])] if weights is None else x
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(7).choice(len(distinct), k, replace=False)]
    w = np.ones(len(x)) if weights is None else weights.astype(float)
    for _ in range(rounds):
        at = nearest(x, centres)
        sums, mass = np.zeros_like(centres), np.bincount(at, w, k)
        np.add.at(sums, at, x * w[:, None])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
    return centres


# ---------------------------------------------------------------- build


def _blocks_of(block_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Blocks of one bounded group of items: its clusters, cut where one holds too many."""

    def build(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item_id", kind="stable")
        x, ids = np.vstack(items["vector"].to_numpy()), items["item_id"].to_numpy(np.int64)
        cell = nearest(x, cluster(x, -(-len(x) // block_rows)))
        out = []
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            for piece in np.array_split(own, -(-len(own) // (2 * block_rows))):
                centre = x[piece].mean(0)
                radius = float(np.sqrt(((x[piece] - centre) ** 2).sum(1).max()))
                out.append((items["part"].iloc[0], items["coarse"].iloc[0], len(piece), radius, centre.tobytes(), ids[piece].tobytes(), x[piece].tobytes()))
        return pd.DataFrame(out, columns=["part", "coarse", "n", "radius", "centre", "ids", "vectors"])

    return build


def _group_centres(items: DataFrame, sizes: DataFrame, group_rows: int, n_groups: int | None) -> dict[str, np.ndarray]:
    """Centres of the groups of every large part, each fitted on a bounded sample of it."""
    large = sizes.where(F.col("n") > (group_rows if n_groups is None else 1))
    wanted = F.least(F.ceil(F.col("n") / group_rows) if n_groups is None else F.lit(n_groups), F.col("n")).cast("int")
    large = large.withColumn("_k", wanted)
    bits = F.pmod(F.xxhash64("item_id"), F.lit(1 << 30))
    sample = attach(items, large, ["part"]).where(bits < F.col("_k") * SAMPLE_ROWS / F.col("n") * (1 << 30))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        centres = cluster(np.vstack(rows["vector"].to_numpy()), int(rows["_k"].iloc[0]))
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "centres": [centres.tobytes()], "k": [len(centres)]})

    found = sample.groupBy("part").applyInPandas(fit, "part string, centres binary, k int")
    # At most twice MOST_GROUPS centres in all, by the choice of group_rows.
    return {r.part: np.frombuffer(r.centres).reshape(r.k, -1) for r in found.collect()}


def _placed(items: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """Items with the nearest group of their part."""

    @F.pandas_udf("int")
    def coarse(part: pd.Series, vector: pd.Series) -> pd.Series:
        out = np.zeros(len(part), np.int32)
        for p in set(part) & set(centres):
            own = np.flatnonzero((part == p).to_numpy())
            out[own] = nearest(np.vstack(vector.iloc[own].to_numpy()), centres[p])
        return pd.Series(out)

    return items.withColumn("coarse", coarse("part", "vector"))


def _written_blocks(items: DataFrame, index: Index, block_rows: int) -> Index:
    """The index with blocks for these placed items added."""
    sizes = items.groupBy("part", "coarse").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_salts"))
    salted = attach(items, sizes, ["part", "coarse"]).withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.col("_salts")))
    made = salted.groupBy("part", "coarse", "_salt").applyInPandas(_blocks_of(block_rows), BLOCK)
    name = F.concat(F.lit(f"{index.generation}-"), F.hex(F.monotonically_increasing_id()))
    stored = materialise(made.withColumn("block", name), "blocks")
    blocks, meta = stored.select("block", "centre", "ids", "vectors"), stored.select("block", "part", "coarse", "n", "radius", "centre")
    if index.generation:
        blocks, meta = index.blocks.unionByName(blocks), index.meta.unionByName(meta)
    return replace(index, blocks=blocks, meta=meta)


def keyed(items: DataFrame, columns: list[str]) -> DataFrame:
    part = F.col("part").cast("string") if "part" in items.columns else F.lit("")
    return items.select(*columns, part.alias("part")).where(F.col("part").isNotNull() & F.col("vector").isNotNull())


def build(items: DataFrame, n_groups: int | None = None, block_rows: int = BLOCK_ROWS) -> Index:
    """Index of items (item_id, vector and, where queries ask a part of the corpus, part)."""
    items = materialise(keyed(items, [F.col("item_id").cast("long").alias("item_id"), "vector"]), "items")
    sizes = materialise(items.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part-sizes")
    found = sizes.agg(F.sum("n").alias("n")).first()
    width = items.agg(F.max(F.size("vector"))).first()[0] or 0
    group_rows = max(GROUP_ROWS, (found.n or 0) // MOST_GROUPS)
    centres = _group_centres(items, sizes, group_rows, n_groups) if width else {}
    return _written_blocks(_placed(items, centres), Index(None, None, width, centres, group_rows), block_rows)


def append(index: Index, items: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    """The index with more items: new blocks in the existing groups, then groups split that have outgrown theirs."""
    items = materialise(keyed(items, [F.col("item_id").cast("long").alias("item_id"), "vector"]), "new-items")
    width = index.width or items.agg(F.max(F.size("vector"))).first()[0] or 0
    grown = replace(index, generation=index.generation + 1, width=width)
    return split_groups(_written_blocks(_placed(items, grown.centres), grown, block_rows))


def split_groups(index: Index) -> Index:
    """Groups of more than twice ``group_rows`` items are split by the centres of their blocks."""
    width = index.width
    sizes = materialise(index.meta.groupBy("part", "coarse").agg(F.sum("n").alias("_n")), "group-sizes")
    over = sizes.where(F.col("_n") > 2 * index.group_rows)
    if sum(map(len, index.centres.values())) >= 2 * MOST_GROUPS or not over.head(1):
        return index
    bits = F.pmod(F.xxhash64("block"), F.lit(1 << 30))
    k = F.ceil(F.col("_n") / index.group_rows).cast("int")
    sample = attach(index.meta, over, ["part", "coarse"]).withColumn("_k", k)
    # About SAMPLE_ROWS block centres for each new group.
    sample = sample.where(bits < F.col("_k") * SAMPLE_ROWS * index.group_rows / BLOCK_ROWS / F.greatest(F.col("_n"), F.lit(1)) * (1 << 30))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([np.frombuffer(c) for c in rows["centre"]])
        centres = cluster(x, int(rows["_k"].iloc[0]), weights=rows["n"].to_numpy())
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "coarse": [rows["coarse"].iloc[0]], "centres": [centres.tobytes()]})

    centres, moved = dict(index.centres), {}
    found = sample.groupBy("part", "coarse").applyInPandas(fit, "part string, coarse int, centres binary").collect()
    for r in sorted(found, key=lambda r: (r.part, r.coarse)):
        new = floats(r.centres, width)
        if len(new) < 2:
            continue
        old = centres.get(r.part, new[:1])
        # The first new centre takes the old one's number, the others follow at the end.
        numbers = [r.coarse, *range(len(old), len(old) + len(new) - 1)]
        merged = np.vstack([old, new[1:]])
        merged[r.coarse] = new[0]
        centres[r.part] = merged
        moved[r.part, r.coarse] = (new, np.array(numbers, np.int32))

    @F.pandas_udf("int")
    def group_of(part: pd.Series, coarse: pd.Series, centre: pd.Series) -> pd.Series:
        out = coarse.to_numpy(np.int32).copy()
        for i, key in enumerate(zip(part, coarse, strict=True)):
            if key in moved:
                new, numbers = moved[key]
                out[i] = numbers[nearest(np.frombuffer(centre.iloc[i])[None], new)[0]]
        return pd.Series(out)

    meta = materialise(index.meta.withColumn("coarse", group_of("part", "coarse", "centre")), "meta")
    return replace(index, meta=meta, centres=centres)


# ---------------------------------------------------------------- search


def group_radii(index: Index) -> dict[str, np.ndarray]:
    """Radius of each group of the large parts, -inf for one without items."""
    if not index.centres:
        return {}
    centres = index.centres

    @F.pandas_udf("double")
    def reach(part: pd.Series, coarse: pd.Series, centre: pd.Series, radius: pd.Series) -> pd.Series:
        return pd.Series([
            float(np.linalg.norm(np.frombuffer(c) - centres[p][g])) + r for p, g, c, r in zip(part, coarse, centre, radius, strict=True)], dtype=float)

    large = index.meta.where(F.col("part").isin(list(centres)))
    out = {p: np.full(len(c), -np.inf) for p, c in centres.items()}
    for r in large.groupBy("part", "coarse").agg(F.max(reach("part", "coarse", "centre", "radius")).alias("r")).collect():
        out[r.part][r.coarse] = r.r
    return out


def with_leaves(index: Index) -> DataFrame:
    """``meta`` with the ``leaf`` of each block: at most about LEAF_BLOCKS blocks of a group share one."""
    sizes = index.meta.groupBy("part", "coarse").agg(F.ceil(F.count(F.lit(1)) / LEAF_BLOCKS).cast("int").alias("_leaves"))
    return attach(index.meta, sizes, ["part", "coarse"]).withColumn("leaf", F.pmod(F.xxhash64("block"), F.col("_leaves"))).drop("_leaves")


def _directory(index: Index) -> DataFrame:
    """(part, coarse, leaf) with the metadata of a leaf's blocks in one row."""
    width = index.width
    rows = with_leaves(index)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        return pd.DataFrame({
            "part": [rows["part"].iloc[0]], "coarse": [rows["coarse"].iloc[0]], "leaf": [rows["leaf"].iloc[0]], "blocks": [rows["block"].tolist()],
            "ns": [rows["n"].to_numpy(np.int64).tobytes()], "radii": [rows["radius"].to_numpy(float).tobytes()],
            "centres": [np.vstack([np.frombuffer(c) for c in rows["centre"]]).reshape(-1, width).tobytes()]})

    schema = "part string, coarse int, leaf long, blocks array<string>, ns binary, radii binary, centres binary"
    return materialise(rows.groupBy("part", "coarse", "leaf").applyInPandas(pack, schema), "directory")


QUERIES = "qids binary, vectors binary, bounds binary"


def packs(key: dict[str, list], ids: list[np.ndarray], vectors: list[np.ndarray], bounds: list[np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows of a key and the queries packed for it."""
    columns = {n: pa.array(v, kinds[n]) for n, v in key.items()}
    columns |= {n: pa.array([x.tobytes() for x in v], pa.binary()) for n, v in (("qids", ids), ("vectors", vectors), ("bounds", bounds))}
    return pa.record_batch(columns)


def asking(queries: DataFrame, index: Index, radii: dict[str, np.ndarray], nearest_groups: int | None = None) -> DataFrame:
    """Queries packed by the groups they ask: so many nearest ones, or all that their bound doesn't rule out.

    With a number of groups, the bound that travels is the group's place among the query's, from 1.
    """
    width, centres = index.width, index.centres
    kinds = {"part": pa.string(), "coarse": pa.int32()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                yield from one(batch.slice(s, 4096))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("query_id").to_numpy()
        x = batch.column("vector").flatten().to_numpy().reshape(-1, width)
        bound, part = batch.column("bound").to_numpy(), np.array(batch.column("part").to_pylist(), object)
        key: dict[str, list] = {"part": [], "coarse": []}
        packed: tuple[list, list, list] = ([], [], [])
        for p in sorted(set(part)):
            own = np.flatnonzero(part == p)
            if p not in centres:
                asked, place = np.ones((len(own), 1), bool), np.ones((len(own), 1))
            else:
                d = np.sqrt(squares(x[own], centres[p]))
                alive = np.isfinite(radii[p])
                place = np.where(alive, d, np.inf).argsort(1, kind="stable").argsort(1, kind="stable") + 1.0
                if nearest_groups is not None:
                    asked = alive & (place <= nearest_groups)
                else:
                    asked = np.zeros(d.shape, bool)
                    asked[:, alive] = (d - radii[p])[:, alive] <= bound[own, None]
            for c in range(asked.shape[1]):
                some = np.flatnonzero(asked[:, c])
                for t in range(0, len(some), PACK_QUERIES):
                    few = some[t : t + PACK_QUERIES]
                    key["part"].append(p)
                    key["coarse"].append(c)
                    packed[0].append(ids[own[few]])
                    packed[1].append(x[own[few]])
                    packed[2].append(bound[own[few]] if nearest_groups is None else place[few, c])
        if key["part"]:
            yield packs(key, *packed, kinds)

    rows = queries.select("query_id", "part", "vector", "bound")
    return rows.mapInArrow(pack, f"part string, coarse int, {QUERIES}")


def _to_blocks(met: DataFrame, width: int, k: int, home: bool) -> DataFrame:
    """Packed queries of a group, met with the group's directory, packed anew by the blocks they visit."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, x, bound = np.frombuffer(row["qids"], np.int64), floats(row["vectors"], width), np.frombuffer(row["bounds"])
                radii, ns = np.frombuffer(row["radii"]), np.frombuffer(row["ns"], np.int64)
                d = np.sqrt(squares(x, floats(row["centres"], width)))
                if home:
                    # The nearest blocks that hold k items together.
                    order = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(ns[order], axis=1) - ns[order]
                    visited = np.zeros(d.shape, bool)
                    np.put_along_axis(visited, order, before < k, axis=1)
                else:
                    visited = d - radii <= bound[:, None]
                hit = np.flatnonzero(visited.any(0))
                if len(hit):
                    some = [np.flatnonzero(visited[:, b]) for b in hit]
                    yield packs(
                        {"block": [row["blocks"][b] for b in hit]}, [ids[s] for s in some], [x[s] for s in some], [bound[s] for s in some], {"block": pa.string()})

    return met.mapInArrow(expand, f"block string, {QUERIES}")


def _scored(packed: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """Best ``k`` items of each visited block for each query in it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                items, ids = floats(row["items"], width), np.frombuffer(row["ids"], np.int64)
                qids, x = np.frombuffer(row["qids"], np.int64), floats(row["vectors"], width)
                scores = np.round(x @ items.T, SCORE_DIGITS)
                keep = min(k, len(ids))
                low = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                q, at = np.nonzero(scores >= low[:, None])
                order = np.lexsort((ids[at], -scores[q, at], q))
                q, at = q[order], at[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                q, at = q[nth < keep], at[nth < keep]
                yield pa.record_batch({"query_id": pa.array(qids[q]), "item_id": pa.array(ids[at]), "score": pa.array(scores[q, at])})

    payload = blocks.select("block", "ids", F.col("vectors").alias("items"))
    return packed.join(payload, "block").mapInArrow(score, "query_id long, item_id long, score double")


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` of (query's number, item id, score) for each query, by query and rank."""
    q, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], ids[first], scores[first]


def _leaf_scores(asked: pa.Table, items: pa.Table, width: int, k: int) -> pa.Table:
    """Best ``k`` items of a leaf for each query of a slice, block by block; the bounds fall as better items are found."""
    joined = lambda t, c, kind: np.concatenate([np.frombuffer(v.as_py(), kind) for v in t.column(c)]) if t.num_rows else np.empty(0, kind)
    ids, bound = joined(asked, "qids", np.int64), joined(asked, "bounds", float)
    x = joined(asked, "vectors", float).reshape(-1, width)
    found, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    # 2 - 2 product <= squared bound, for all that count.
    low = 1 - bound * bound / 2
    for i in range(items.num_rows if len(ids) else 0):
        row = items.slice(i, 1).to_pylist()[0]
        y, own_ids = floats(row["vectors"], width), np.frombuffer(row["ids"], np.int64)
        near = np.flatnonzero(np.sqrt(squares(x, np.frombuffer(row["centre"])[None]))[:, 0] - row["radius"] <= bound)
        for s in range(0, len(near), 4096):
            own = near[s : s + 4096]
            scores = np.round(x[own] @ y.T, SCORE_DIGITS)
            hit = scores >= low[own, None]
            many = np.flatnonzero(hit.sum(1) > k)
            if len(many):
                hit[many] &= scores[many] >= -np.partition(-scores[many], k - 1, axis=1)[:, k - 1 : k]
            q, at = np.nonzero(hit)
            found.append((own[q], own_ids[at], scores[q, at]))
            held += len(q)
        if held > 4 * k * len(ids):
            found = [_best(found, k)]
            q, _, scores = found[0]
            held, last = len(q), np.flatnonzero(np.bincount(q, minlength=len(ids)) == k)
            low[last] = np.maximum(low[last], scores[np.searchsorted(q, last, "right") - 1])
            bound[last] = np.minimum(bound[last], np.sqrt(np.maximum(2 - 2 * low[last], 0.0) + SLACK))
    q, item, scores = _best(found, k)
    return pa.table({"query_id": pa.array(ids[q]), "item_id": pa.array(item), "score": pa.array(scores)})


def _searched(queries: DataFrame, index: Index, radii: dict[str, np.ndarray], k: int, leaf_bytes: int) -> DataFrame:
    """Best ``k`` items of every leaf that a query's bound allows (written queries: query_id, part, vector, bound)."""
    width, group = index.width, ["part", "coarse"]
    rows = max(1, leaf_bytes // (8 * width))
    asked = asking(queries, index, radii)
    load = asked.groupBy(*group).agg(F.ceil(F.sum(F.octet_length("qids")) / 8 / rows).alias("_slices"))
    leaves = index.meta.groupBy(*group).agg(F.ceil(F.sum("n") / rows).alias("_leaves"))
    # Groups that no query asks aren't read.
    grid = materialise(load.join(leaves, group), "grid")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asked.join(grid, group).withColumn("_slice", F.pmod(F.xxhash64("qids"), F.col("_slices"))).withColumn("_leaf", every("_leaves"))
    items = index.blocks.join(index.meta.select("block", *group, "radius"), "block").join(grid, group)
    items = items.withColumn("_leaf", F.pmod(F.xxhash64("block"), F.col("_leaves"))).withColumn("_slice", every("_slices"))
    key = [*group, "_leaf", "_slice"]
    asked, items = asked.select(*key, "qids", "vectors", "bounds"), items.select(*key, "radius", "centre", "ids", "vectors")

    def score(asked: pa.Table, items: pa.Table) -> pa.Table:
        return _leaf_scores(asked, items, width, k)

    return asked.groupBy(*key).cogroup(items.groupBy(*key)).applyInArrow(score, "query_id long, item_id long, score double")


def search(queries: DataFrame, index: Index, k: int, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Exact best ``k`` items by inner product for each query (query_id, vector and part, if the items have one).

    The blocks nearest to a query bound the distance of its k-th neighbour; the second pass visits
    all leaves, and in them all blocks, that may hold a nearer one.
    """
    columns = [F.col("query_id").cast("long").alias("query_id"), "vector"]
    rows = materialise(keyed(queries, columns).withColumn("bound", F.lit(float("inf"))), "queries")
    if not index.width:
        return rows.select("query_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    radii, directory = group_radii(index), _directory(index)
    order = [F.desc("score"), F.col("item_id")]
    first = asking(rows, index, radii, 1).join(directory.where("leaf = 0"), ["part", "coarse"])
    near = _scored(_to_blocks(first, index.width, k, True), index.blocks, index.width, k)
    near = top_k(near, ["query_id"], order, k).where(F.col("rank") == k)
    # Lengths of at most 1: squared distance <= 2 - 2 product.
    bound = near.select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)) + SLACK).alias("_bound"))
    bounded = attach(rows, bound, ["query_id"], "left").withColumn("bound", F.coalesce("_bound", "bound")).drop("_bound")
    return top_k(_searched(materialise(bounded, "bounded"), index, radii, k, leaf_bytes), ["query_id"], order, k)
