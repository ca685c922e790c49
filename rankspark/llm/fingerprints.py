"""Document fingerprints from improbable features.

A feature is a window of 64 bytes. Windows are ranked by how rare their entropy is in the corpus
(the histogram counts every window of every document); in each run of 64 windows the rarest is marked,
and windows marked often enough are the features. They go, 160 to a filter, into a chain of Bloom
filters of 2048 bits. Two chains are as alike as the mean, over the filters of the shorter one, of
the best overlap beyond chance with a filter of the other.

Defined cases: null text is empty; the empty text has no filters and is alike to itself alone; a
text shorter than a window is one feature; null ids come last in descending order; rows with equal
ids follow each other by text; a single document follows itself; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8

WINDOW = 64
#: A window is a feature if it is the rarest of so many of the runs that it lies in.
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
LEVELS = 1001
#: Bytes worked on at a time.
SLICE = 1 << 20

_SCALE = 1 << 16
#: c * log2(c) as integers, so that sums don't depend on where in a batch a text stands.
_TERM = np.round([c * np.log2(c or 1) * _SCALE for c in range(WINDOW + 1)]).astype(np.int64)
_STEP = np.diff(_TERM, prepend=0)
_MOST = int(_TERM[WINDOW])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _levels(sums: np.ndarray) -> np.ndarray:
    """Entropy as 0 to 1000 of what is possible."""
    return (_MOST - sums) * (LEVELS - 1) // _MOST


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level of every window of some bytes, by counting what each step adds and takes away."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    if n > SLICE + WINDOW:
        starts = range(0, n - WINDOW + 1, SLICE)
        return np.concatenate([entropy_levels(data[s : s + SLICE + WINDOW - 1]) for s in starts])
    order = np.argsort(data, kind="stable")
    place = order + data[order].astype(np.int64) * (n + WINDOW)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        close = place[k:] - place[:-k] < WINDOW
        if not close.any():
            break
        ahead[:-k] += close
        behind[k:] += close
    after, before = np.empty(n, np.uint8), np.empty(n, np.uint8)
    after[order], before[order] = ahead, behind  # the same byte in the window from here on, and up to here
    first = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    steps = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    return _levels(np.concatenate(([first], first + np.cumsum(steps))))


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level: every window within a text, none across two."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    within, end = np.ones(len(data), bool), 0
    for text in texts:
        start, end = end, end + len(text)
        within[max(start, end - WINDOW + 1) : end] = False
    counts = np.zeros(LEVELS, np.int64)
    for s in range(0, len(data) - WINDOW + 1, SLICE):
        levels = entropy_levels(data[s : s + SLICE + WINDOW - 1])
        counts += np.bincount(levels[within[s : s + len(levels)]], minlength=LEVELS)
    return counts


def level_ranks(documents: DataFrame) -> np.ndarray:
    """For each level its rank: 0 for the rarest over every window of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(LEVELS, np.int64)
        for batch in row_slices(batches, 64):
            held += level_counts(batch.column(0).to_pylist())
        yield pa.record_batch({"level": pa.array(np.arange(LEVELS)), "times": pa.array(held)})

    counts = documents.select(utf8("text").alias("text")).mapInArrow(count, "level long, times long")
    times = np.zeros(LEVELS, np.int64)
    for row in counts.groupBy("level").agg(F.sum("times").alias("times")).collect():
        times[row["level"]] = row["times"]
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort((np.arange(LEVELS), times))] = np.arange(LEVELS)
    return ranks


def select_features(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (places in ``ranks``) of texts whose windows stand one after another, and how many each has."""
    n, ends = len(ranks), np.cumsum(sizes)
    starts = ends - sizes
    found = np.zeros(n, bool)
    if n >= WINDOW:
        low = ranks << 40 | np.arange(n)
        width = 1
        while width < WINDOW:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        whole = np.zeros(n + 1, np.int64)
        long = sizes >= WINDOW
        np.add.at(whole, starts[long], 1)
        np.add.at(whole, ends[long] - WINDOW + 1, -1)
        runs = np.flatnonzero(np.cumsum(whole)[: len(low)])
        votes = np.bincount(low[runs] & ((1 << 40) - 1), minlength=n)
        found = votes >= POPULAR
    counts = np.add.reduceat(np.append(found, False).astype(np.int64), starts) if len(starts) else starts
    counts = np.where(sizes > 0, counts, 0)
    for i in np.flatnonzero((counts == 0) & (sizes > 0)):
        own = slice(starts[i], ends[i])
        best = np.argmax(votes[own]) if sizes[i] >= WINDOW else np.argmin(ranks[own])
        found[starts[i] + best] = True
        counts[i] = 1
    return np.flatnonzero(found), counts


def _window_hashes(windows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(windows).view(np.uint64)
    mixed = np.full(len(words), WINDOW, np.uint64)
    for i in range(words.shape[1]):
        mixed = (mixed * _B) ^ words[:, i]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _A
        mixed ^= mixed >> np.uint64(29)
    return mixed


def filter_chains(texts: list[bytes], ranks: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """For each text its number of features and its filters, a row of bytes each. ranks: of its windows."""
    sizes = np.array([len(r) for r in ranks], np.int64)
    places, counts = select_features(np.concatenate(ranks) if ranks else np.empty(0, np.int64), sizes)
    # The windows' places in the joined texts: each text has WINDOW - 1 bytes more than windows.
    lengths = np.array([max(len(t), WINDOW) if t else 0 for t in texts], np.int64)
    data = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") if t else b"" for t in texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), counts)
    at = places - (np.cumsum(sizes) - sizes)[of] + (np.cumsum(lengths) - lengths)[of]
    hashes = np.empty(len(at), np.uint64)
    for s in range(0, len(at), 1 << 16):
        hashes[s : s + (1 << 16)] = _window_hashes(data[at[s : s + (1 << 16), None] + np.arange(WINDOW)])
    n_filters = -(-counts // FILTER_FEATURES)
    first = np.cumsum(n_filters) - n_filters
    nth = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    bits = np.zeros(int(n_filters.sum()) * FILTER_BITS, np.uint8)
    base = (first[of] + nth // FILTER_FEATURES) * FILTER_BITS
    for i in range(HASHES):
        bits[base + (hashes >> np.uint64(11 * i) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    filters = np.packbits(bits.reshape(-1, FILTER_BITS), axis=1)
    return [(int(c), filters[f : f + k]) for c, f, k in zip(counts, first, n_filters, strict=True)]


def fingerprint_text(chain: tuple[int, np.ndarray]) -> str:
    return f"{chain[0]}:{chain[1].tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the shorter chain of the best overlap with the other, beyond chance (0) up to all that is possible (1)."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    if a.shape == b.shape and (a == b).all():
        return 1.0
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, ones in zip(a, ones_a, strict=True):
        both = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        chance, most = ones * ones_b / FILTER_BITS, np.minimum(ones, ones_b)
        total += float(np.max((both - chance) / np.maximum(most - chance, 1e-9)))
    return min(1.0, max(0.0, total / len(a)))


def texts_ranks(texts: list[bytes], level_rank: np.ndarray) -> list[np.ndarray]:
    """Ranks of the windows of each text; one window for a text shorter than that."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ranks, at, out = level_rank[entropy_levels(data)], 0, []
    for text in texts:
        n = len(text)
        out.append(ranks[at : at + n - WINDOW + 1] if n >= WINDOW else np.zeros(min(n, 1), np.int64))
        at += n
    return out


def edited(text: str, following: str) -> tuple[bytes, bytes]:
    """What stays of a text, and what of the next one replaces its last third."""
    k = len(text) // 3
    return text[: len(text) - k].encode(), following[:k].encode()


def fingerprint_rows(texts: list[bytes], level_rank: np.ndarray) -> list[tuple]:
    """For each text but the last: n_chars, hash of the edited text, both fingerprints and likenesses."""
    ranks = texts_ranks(texts, level_rank)
    own = filter_chains(texts, ranks)
    strings = [t.decode() for t in texts]
    parts = [edited(a, b) for a, b in zip(strings, strings[1:], strict=False)]
    # Only the windows across the joint are new.
    joints = texts_ranks([(a + b)[max(0, len(a) - WINDOW + 1) : len(a) + WINDOW - 1] for a, b in parts], level_rank)
    new_ranks = []
    for i, (a, b) in enumerate(parts):
        kept = ranks[i][: max(0, len(a) - WINDOW + 1)]
        came = ranks[i + 1][: max(0, len(b) - WINDOW + 1)] if len(b) >= WINDOW else ranks[i][:0]
        new_ranks.append(np.concatenate((kept, joints[i], came)) if b else texts_ranks([a], level_rank)[0])
    new_texts = [a + b for a, b in parts]
    new = filter_chains(new_texts, new_ranks)
    return [
        (len(strings[i]), hashlib.sha256(new_texts[i]).hexdigest(), fingerprint_text(own[i]), fingerprint_text(new[i]),
         likeness(own[i][1], new[i][1]), likeness(own[i][1], own[i + 1][1]))
        for i in range(len(parts))
    ]


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (bucket, halo, doc_id, text) in descending order of id, in buckets of id ranges.

    A bucket's last document is followed by its halo: the first of the next bucket that has any (after
    the last bucket, the first of all). So a text is shuffled once, but for one in each bucket.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    n_buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx("key", [i / n_buckets for i in range(1, n_buckets)]).alias("q")).first()["q"] or []
    bounds = sorted(set(bounds), reverse=True)
    # Bucket 0 has the largest ids; each bound is the first id of a bucket.
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b >= F.col("key")))
    highest = sorted((r["bucket"], r["key"]) for r in rows.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("key")).collect())
    follows = [(key, highest[i - 1][0]) for i, (_, key) in enumerate(highest)]
    halo = spark.createDataFrame(follows or [(None, None)], "key long, to int").groupBy("key").agg(F.collect_list("to").alias("to"))
    copies = F.concat(
        F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("halo"))),
        F.coalesce(F.transform("to", lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("halo"))), F.array().cast("array<struct<bucket:int,halo:int>>")))
    placed = rows.join(F.broadcast(halo), "key", "left").select(F.explode(copies).alias("at"), "key", "doc_id", "text")
    return placed.select("at.bucket", "at.halo", "key", "doc_id", "text").repartition(n_buckets, "bucket").sortWithinPartitions(
        "bucket", "halo", F.desc("key"), "text").select("bucket", "halo", "doc_id", "text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of all ``documents`` (columns doc_id, text) and of their edited texts."""
    documents = documents.select("doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(level_ranks(documents))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            found = fingerprint_rows([t for _, t in held], shared.value)
            columns = [[d for d, _ in held[:-1]], *map(list, zip(*found, strict=True))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held, size, now, done = [], 0, None, False
        for batch in row_slices(batches, 64):
            for bucket, halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    held, size, now, done = [], 0, bucket, False
                if done:
                    continue  # rows that share the id of the halo
                held.append((doc_id, text))
                size += len(text)
                if halo or (size >= SLICE // 2 or len(held) > 256) and len(held) > 1:
                    if len(held) > 1:
                        yield out(held)
                    held, size, done = held[-1:], len(text), bool(halo)

    return with_next(documents).mapInArrow(
        rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text, and how alike these and the next document are."""
    return fingerprints(table(spark, sf_dir, "documents"))
