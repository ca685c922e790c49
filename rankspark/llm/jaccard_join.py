"""Similarity join of documents on word n-grams (shingles) by rare-first prefix filtering.

Steps, each a Spark job over written tables:

1. ``frequent_shingles`` counts shingles over all documents. Only the order of the prefixes rests
   on it, never the result, so it keeps the table of frequent ones, bounded by construction.
2. ``sketches`` orders each document's set by (frequency, hash) and keeps the *prefix*: two sets
   that are similar enough share an n-gram of their prefixes.
3. Documents with equal sets form a class; only classes go on.
4. Classes that share a prefix n-gram become candidates under the length and positional filters,
   first each against one hub per n-gram (linear in the group), then all pairs that are not
   known to be connected. Candidates pass a suffix filter and are verified once each, on the
   whole sets.
5. Components of the verified links, by star steps.

For components no pair within a connected group is enumerated beyond those with its hubs;
``similarity_join`` enumerates and verifies all candidates, for all links and the links of each
document. No list of candidates is cut. Set members are 64-bit hashes of the n-grams.

Defined cases: null or empty text, or text without words, is an empty set, which links with
nothing; a text of fewer words than n is one n-gram; rows that share a doc_id count as one
document; null ids can link documents but are never a component's name unless it has no other
(then the component_id is null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.components import components
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8
from rankspark.operators import skew

#: Shingles counted at a time in pass one; a shingle that is twice in such a chunk is a candidate for the frequent ones.
CHUNK = 1 << 21
#: Entries that the table of frequent shingles can have, which is broadcast: those of the highest counts.
MOST_FREQUENT = 2_000_000
#: A set of ids up to this size may be broadcast; beyond, the same join is a shuffle.
BROADCAST_IDS = 1_000_000
#: Ranges of the hash space that the suffix filter compares.
RANGES = 64
SKETCH = "doc_id long, sig binary, n int, ranges binary, low long, high long, prefix array<long>"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams: words are lower-cased (A-Z) and cut at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = _mixed(mixed * _B + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(mixed)


def frequent_shingles(documents: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the frequent shingles, sorted by hash.

    Every chunk of the data reports what it holds at least twice; of the sums the highest are kept,
    by steps of count, so that there are MOST_FREQUENT of them at most.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 1
            return pa.record_batch({"h": pa.array(values[often].view(np.int64)), "times": pa.array(times[often].astype(np.int64))})

        held, size = [], 0
        for batch in row_slices(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text, n))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    spark = documents.sparkSession
    found = session.materialise(
        documents.select(utf8("text").alias("text")).mapInArrow(counts, "h long, times long")
        .groupBy("h").agg(F.sum("times").alias("times")), "shingle-counts")
    step = F.floor(8 * F.log2("times"))
    held, least = 0, None
    for row in found.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():  # a few hundred rows
        held += row["k"]
        if held > MOST_FREQUENT:
            break
        least = row["step"]
    rows = found.where(step >= least if least is not None else F.lit(False)).toArrow()
    values, times = rows.column("h").to_numpy().view(np.uint64), rows.column("times").to_numpy()
    order = np.argsort(values)
    return values[order], times[order]


def ranges_of(shingles: np.ndarray) -> bytes:
    """How many of a set fall in each range of the hash space, in the narrowest width that holds them."""
    held = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=RANGES)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if held.max(initial=0) <= np.iinfo(k).max)
    return held.astype(kind).tobytes()


def coarse_ranges(data: bytes) -> tuple[int, int]:
    """The same for 16 ranges, a byte each in two numbers; all bits are set if a byte can't hold one."""
    held = ranges_from(data).reshape(16, -1).sum(axis=1)
    if held.max(initial=0) > 255:
        return -1, -1
    low, high = held.astype(np.uint8).view("<i8").tolist()
    return low, high


def ranges_from(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // RANGES]).astype(np.int64)


def sketches(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document row: signature and size of its set, range counts, prefix (rarest first)."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent_shingles(documents, n))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = shared.value
        for batch in row_slices(batches):
            rows: dict[str, list] = {"sig": [], "n": [], "ranges": [], "low": [], "high": [], "prefix": []}
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, n)
                size = len(found)
                frequency = np.zeros(size, np.int64)
                if len(values) and size:
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    frequency = np.where(values[at] == found, times[at], 0)
                length = size - -(-percent * size // 100) + 1 if size else 0
                order = np.lexsort((found, frequency))[:length]
                rows["sig"].append(xxhash.xxh3_128_digest(found.tobytes()))
                rows["n"].append(size)
                rows["ranges"].append(ranges_of(found))
                low, high = coarse_ranges(rows["ranges"][-1])
                rows["low"].append(low)
                rows["high"].append(high)
                rows["prefix"].append(found[order].view(np.int64))
            kinds = {"sig": pa.binary(), "n": pa.int32(), "ranges": pa.binary(), "low": pa.int64(), "high": pa.int64(), "prefix": pa.list_(pa.int64())}
            yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array(rows[k], kinds[k]) for k in kinds})

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return session.materialise(narrow.mapInArrow(sketch, SKETCH), "sketches")


def needed(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of such sizes: 100 i >= percent (a + b - i)."""
    return F.floor(((a + b) * percent + 99 + percent) / (100 + percent)).cast("int")


def _overlap_fits(left: str, right: str, percent: int) -> Column:
    """Suffix filter within a join: the coarse range counts bound the intersection."""
    most = F.lit(0)
    for name in ("low", "high"):
        for shift in range(0, 64, 8):
            most += F.least(*(F.shiftrightunsigned(F.col(f"{side}.{name}"), shift).bitwiseAND(F.lit(255)) for side in (left, right)))
    full = (F.col(f"{left}.low") == -1) | (F.col(f"{right}.low") == -1)
    return full | (most >= needed(F.col(f"{left}.n"), F.col(f"{right}.n"), percent))


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: the range counts of both sets bound their intersection."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 8192):
            if not batch.num_rows:
                continue
            left = np.stack([ranges_from(x) for x in batch.column("ranges_a").to_pylist()])
            right = np.stack([ranges_from(x) for x in batch.column("ranges_b").to_pylist()])
            most = np.minimum(left, right).sum(axis=1)
            stay = 100 * most >= percent * (left.sum(axis=1) + right.sum(axis=1) - most)
            yield batch.select(["a", "b"]).filter(pa.array(stay))

    return pairs.mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) of classes whose whole sets are similar enough, as a written table."""
    profile = classes.select("node", "ranges")
    pairs = _likely(
        pairs.join(profile.select(F.col("node").alias("a"), F.col("ranges").alias("ranges_a")), "a")
        .join(profile.select(F.col("node").alias("b"), F.col("ranges").alias("ranges_b")), "b"), percent)
    pairs = session.materialise(pairs, "candidates")
    nodes = session.materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    few = nodes.count() <= BROADCAST_IDS
    members = classes.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", F.col("rep").alias("of"))
    # The text of one document stands for a class; rows that share its id are rows of the same document.
    texts = session.materialise(
        documents.select(F.col("doc_id").cast("long").alias("rep"), utf8("text").alias("text"))
        .join(F.broadcast(members) if few else members, F.col("rep").eqNullSafe(F.col("of"))).select("node", "text"), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            sets: dict[int, np.ndarray] = {}
            a, b, stay = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (text_a, text_b) in enumerate(zip(
                    batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
                left = shingle_set(text_a, n)
                key = (b[i], hash(text_b))
                if key not in sets:
                    sets[key] = shingle_set(text_b, n)
                right = sets[key]
                both = len(np.intersect1d(left, right, assume_unique=True))
                stay.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).filter(pa.array(stay, pa.bool_()))

    with_texts = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    )
    return session.materialise(with_texts.mapInArrow(check, "a long, b long").distinct(), "links")


def _near(left: str, right: str, percent: int) -> Column:
    """Length and positional filters of two postings of the same n-gram.

    Before it each set has ``pos`` n-grams, of which ``shared`` are in another prefix too; only
    these can be in both sets, as both list them in the same order.
    """
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    after = F.least(a - F.col(f"{left}.pos"), b - F.col(f"{right}.pos"))
    least = needed(a, b, percent)
    return (least <= F.least(a, b)) & (F.least(f"{left}.shared", f"{right}.shared") + after >= least)


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): a node it is linked with, the smallest; nodes with one label are connected."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))


def linked(classes: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes, enough to connect all that are similar."""
    postings = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    # What no other class has can't make a pair; the rest is written with the hubs of its n-gram: the
    # set that has the fewest rarer n-grams of its own, and the longest set.
    frequent = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    before = F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1
    shared = session.materialise(postings.join(frequent, "token").withColumn("shared", before), "postings")
    hubs = shared.groupBy("token").agg(
        F.min(F.struct("pos", "n", "node", "shared")).alias("low"), F.max(F.struct("n", "pos", "node", "shared")).alias("high"))
    shared = session.materialise(shared.join(hubs, "token"), "postings")

    links = tested = None
    for hub in ("low", "high"):
        ask = shared
        if links is not None:
            labels = _labels(links)
            ask = (
                shared.join(labels, "node", "left")
                .join(labels.select(F.col("node").alias("hub_node"), F.col("label").alias("hub_label")),
                      F.col(f"{hub}.node") == F.col("hub_node"), "left")
                .where(F.coalesce("label", "node") != F.coalesce("hub_label", f"{hub}.node"))
            )
        near = F.struct("node", "n", "pos", "shared")
        pairs = (
            ask.select(near.alias("x"), F.col(hub).alias("y")).where("x.node <> y.node").where(_near("x", "y", percent))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = session.materialise(pairs, "pairs")
        found = _verified(pairs, classes, documents, n, percent)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)

    # All pairs of an n-gram that aren't known to be connected, by whatever number of links. The most
    # common label of an n-gram is joined with the others only, so a large connected group meets just
    # what lies outside it.
    labelled = skew.attach(shared, components(links), ["node"], "left").select(
        "token", "node", "n", "pos", "shared", F.coalesce("label", "node").alias("label"))
    labelled = session.materialise(labelled, "postings")
    sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels"))
    mixed = labelled.join(main.where("labels > 1").select("token", "main"), "token")
    mixed = mixed.withColumn("inside", F.col("label") == F.col("main")).drop("main")
    mixed = session.materialise(mixed.join(classes.select("node", "low", "high"), "node"), "postings")
    x, y = mixed.where("not inside").alias("x"), mixed.alias("y")
    rest = (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label"))
               & (F.col("y.inside") | (F.col("x.node") < F.col("y.node"))) & _near("x", "y", percent) & _overlap_fits("x", "y", percent))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    return links.unionByName(_verified(session.materialise(rest, "pairs"), classes, documents, n, percent))


def _classes(rows: DataFrame) -> DataFrame:
    """Documents with equal sets as one row, named by the smallest id."""
    classes = (
        rows.where("n > 0").groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("ranges", "low", "high", "prefix")))
    )
    # Classes without any id get a stand-in beyond all ids, so that they can link too.
    stand_in = F.shiftrightunsigned(F.xxhash64("sig"), 2) + F.lit(1 << 62)
    return session.materialise(classes.withColumn("node", F.coalesce("rep", stand_in)), "classes")


def similarity_join(documents: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join: members (doc_id, class) and all links (a, b) between classes, a < b.

    Every row of ``documents`` is a member; an empty set has no class. Rows of one class have equal
    sets and are linked too. Classes are those of distinct texts (by 64-bit hashes), so rows that
    share an id, or have none, are linked by their own texts only.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).withColumn("key", F.xxhash64("text"))
    texts = session.materialise(rows.groupBy("key").agg(F.first("text").alias("text")).withColumnRenamed("key", "doc_id"), "distinct-texts")
    found = sketches(texts, n, percent)
    classes = _classes(found)
    postings = classes.select("node", "n", "low", "high", F.posexplode("prefix").alias("pos", "token"))
    frequent = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    before = F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1
    postings = session.materialise(postings.join(frequent, "token").withColumn("shared", before), "postings")
    x, y = postings.alias("x"), postings.alias("y")
    pairs = x.join(
        y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & _near("x", "y", percent) & _overlap_fits("x", "y", percent)
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = _verified(session.materialise(pairs, "pairs"), classes, texts, n, percent)
    of_text = found.where("n > 0").select(F.col("doc_id").alias("key"), "sig").join(classes.select("sig", F.col("node").alias("class")), "sig")
    return rows.select("doc_id", "key").join(of_text.select("key", "class"), "key", "left").select("doc_id", "class"), links


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_links) per member: how many other rows are similar, from what ``similarity_join`` gives."""
    sizes = session.materialise(members.where("class is not null").groupBy("class").agg(F.count("*").alias("size")), "class-sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, F.col("b") == F.col("class")).groupBy("a").agg(F.sum("size").alias("others"))
    counts = sizes.join(others, F.col("class") == F.col("a"), "left").select(
        "class", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, "class", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``documents`` (columns doc_id and text).

    Documents link when 100 * intersection >= percent * union of their sets of word n-grams; a
    component's id is the smallest doc_id in it.
    """
    documents = documents.select("doc_id", "text")
    rows = sketches(documents, n, percent)
    classes = _classes(rows)
    labels = components(linked(classes, documents, n, percent))
    named = (
        classes.join(labels, "node", "left").select("sig", F.coalesce("label", "node").alias("label"))
        .join(classes.select(F.col("node").alias("label"), F.col("rep").alias("component_id")), "label").drop("label")
    )
    found = rows.select("doc_id", "n", "sig").join(named, "sig", "left")
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
