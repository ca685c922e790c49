"""Best-fit packing of token sequences by large-item matching.

Which pieces share a sequence depends on their lengths only, and there are at most ``capacity``
different ones. So the plan is made from the number of pieces of each length, over all documents
at once: pieces over a third of the capacity are matched greedily, two to a bin at most (the
longest left with the longest that still fits), and shorter ones, by descending length, fill the
smallest gap that takes them. The plan is a list of *runs*: so many bins in a row that get the same
pieces. Each piece then finds its place by its rank among those of its length, which Spark counts
per partition and sums over the partitions.

Defined cases: null text is empty (one piece with the end id); rows with equal or null ids are
packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.encoder import encoder
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int, keeps_space: bool = False) -> DataFrame:
    """One row per piece of a document; ``nth``: its number among those of its length in its partition ``part``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, keeps_space), np.array([END_ID], "<u4").tobytes()
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in row_slices(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for start in range(0, len(ids) // 4, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc_id, start // capacity, start, length, zlib.crc32(piece), part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return session.materialise(narrow.mapInArrow(cut, PIECES), "pieces")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of places, sorted by (length, first rank).

    A row: length, first rank, pieces per bin, first bin, offset in the bin. Piece ``r`` of a run
    goes to bin ``first bin + r // per bin`` at ``offset + r % per bin * length``.
    """
    left = {length: k for length, k in counts.items() if k}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, bins), ascending
    n_bins = 0

    def place(length: int, pieces: int, per_bin: int, first_bin: int, offset: int) -> None:
        runs.append((length, rank[length], per_bin, first_bin, offset))
        rank[length] += pieces
        left[length] -= pieces

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        mate = large[at] if at >= 0 else None
        if mate is None or mate == longest and left[longest] == 1:
            # A single piece of the longest that fits only itself may still take a shorter mate.
            mate = large[at - 1] if mate is not None and at > 0 else None
        if mate is None:
            bins = left[longest]
            place(longest, bins, 1, n_bins, 0)
            used = longest
        elif mate == longest:
            bins = left[longest] // 2
            place(longest, 2 * bins, 2, n_bins, 0)
            used = 2 * longest
        else:
            bins = min(left[longest], left[mate])
            place(longest, bins, 1, n_bins, 0)
            place(mate, bins, 1, n_bins, longest)
            used = longest + mate
        if used < capacity:
            bisect.insort(gaps, (capacity - used, n_bins, bins))
        n_bins += bins
        large = [x for x in large if left[x]]

    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):  # new bins, as many as the rest of this length fills
                bins = -(-left[length] // (capacity // length))
                gaps.append((capacity, n_bins, bins))
                n_bins += bins
            gap, first, bins = gaps.pop(at)
            per_bin = gap // length
            full = min(bins, left[length] // per_bin)
            if full:
                place(length, full * per_bin, per_bin, first, capacity - gap)
                if gap > per_bin * length:
                    bisect.insort(gaps, (gap - per_bin * length, first, full))
                first, bins = first + full, bins - full
            if bins and left[length] and full * per_bin >= 0 and left[length] < per_bin:
                rest = left[length]
                place(length, rest, rest, first, capacity - gap)
                if gap > rest * length:
                    bisect.insort(gaps, (gap - rest * length, first, 1))
                first, bins = first + 1, bins - 1
            if bins:
                bisect.insort(gaps, (gap, first, bins))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Places (sequence_id, offset) of all pieces of ``documents`` (columns doc_id and text)."""
    spark = documents.sparkSession
    cut = pieces(documents, tokenizer, capacity)
    held = session.materialise(cut.groupBy("part", "length").agg(F.count("*").alias("k")), "piece-counts")
    # At most ``capacity`` rows come to the driver, however many documents there are.
    counts = {r["length"]: r["k"] for r in held.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    runs = spark.sparkContext.broadcast(plan(counts, capacity))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("part", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(rank), np.int64)
            for one in np.unique(length):
                of, low, high = length == one, starts[one], starts[one + 1]
                at[of] = low + np.searchsorted(table[low:high, 1], rank[of], side="right") - 1
            run = table[at]
            nth = rank - run[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*columns, pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
