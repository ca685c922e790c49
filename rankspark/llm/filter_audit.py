"""Audit of filters and their order, as a stream that takes back what smaller ids overturn.

The document files come as available-now micro-batches. Each document gets a mask of the filters it
fails by itself (bits A to D). Whether it repeats the text of a smaller id (bit E) depends on all
files: keyed state holds, for each text, the smallest id so far and the documents that bear it. Rows
of larger ids fail E for good. When a smaller id arrives, the documents of the old one are taken
back from the counters without E (a negative count) and entered with it. What leaves the stream are
these changes (doc_id, part, mask, n); their sums are right after each micro-batch, and a later run
on the same checkpoint goes on with the files that are new.

A key of the state is a bucket of text digests, about ``TEXTS_PER_KEY`` of them, so that the calls
into Python are few; what a key holds is bounded by that, whatever the copies. A task passes on one
row per text for its smallest id, and the other copies go around the state, so a text that a third of
all rows have gives each micro-batch at most one state row per task and part. State is kept by
RocksDB on the executors' disks with its changes in the shared folder.

All 120 orders are counted from the sums per (part, mask), at most 32 a part.

Defined cases: null texts are empty; null languages are the empty part; a null id is smaller than no
other and larger than none, so such a document neither fails E nor makes another fail; repeated ids
are documents of their own, and rows of one id and text don't repeat each other; several labels of an
id count as good or toxic if one of them is; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, utf8
from rankspark.operators import skew

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT, CAPITAL_PERCENT = 80, 10
REPEATED = 1 << FILTERS.index("E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = re.compile(rb"[#$%&*|]")

#: Micro-batches that a run has at least, if there are so many files, and the files that one has at most.
LEAST_BATCHES, MOST_FILES = 4, 20_000
#: Texts that share a key of the state, about.
TEXTS_PER_KEY = 256
#: Distinct (text, id, part) that a task holds before it passes them on.
HELD = 200_000
#: Rows that go around the state together; their keys are negative.
AROUND = 2_000

#: An id that is null is 0 with ``has_id`` false: integers with nulls would become floats in pandas.
CHANGE = "doc_id long, has_id boolean, part string, mask int, n long"
FIELDS = ["doc_id", "has_id", "part", "mask", "n"]


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n_words = len(words)
    mask = int(n_words < LEAST_WORDS)
    if 100 * len(set(words)) < DISTINCT_PERCENT * n_words:
        mask |= 2
    capitals = len(text) - len(text.translate(None, CAPITALS))
    # Only where the bytes would do are the code points counted; they are fewer.
    if capitals and 100 * capitals > CAPITAL_PERCENT * (len(text) if text.isascii() else len(text.decode("utf-8", "replace"))):
        mask |= 4
    return mask | 8 if SIGNS.search(text) else mask


def combined(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """(key, digest, change) of a task's documents: for each text its smallest id, and the rest around the state."""
    held: dict[bytes, tuple[int, dict[int | None, dict[str, int]]]] = {}
    task, turn, size = TaskContext.get().partitionId(), 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        rows, around = [], []
        for digest, (mask, ids) in held.items():
            least = min((i for i in ids if i is not None), default=None)
            for doc_id, parts in ids.items():
                for part, n in parts.items():
                    if doc_id is not None and doc_id == least:
                        rows.append((int.from_bytes(digest[:8]) % keys, digest, doc_id, True, part, mask, n))
                    else:
                        around.append((doc_id or 0, doc_id is not None, part, mask if doc_id is None else mask | REPEATED, n))
        for s in range(0, len(around), AROUND):
            rows += [(-1 - (task << 24 | turn), b"", *r) for r in around[s : s + AROUND]]
            turn += 1
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "digest", *FIELDS])

    for batch in row_slices(batches):
        for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            digest = hashlib.blake2b(text, digest_size=16).digest()
            if digest not in held:
                held[digest] = (mask_of(text), {})
            parts = held[digest][1].setdefault(doc_id, {})
            size += part not in parts
            parts[part] = parts.get(part, 0) + 1
        if size >= HELD:
            yield from out()
            held, size = {}, 0
    yield from out()


def _packed(texts: dict[str, list]) -> bytes:
    return zlib.compress(json.dumps(texts, separators=(",", ":")).encode(), 1)


def changes_of(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes that new rows bring to the texts of one key, and its new state: digest -> smallest id, mask, count of each part."""
    if key[0] < 0:
        for frame in frames:
            yield frame[FIELDS]
        return
    texts: dict[str, list] = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
    out = []
    for frame in frames:
        for digest, doc_id, part, mask, n in zip(*(frame[c].tolist() for c in ("digest", "doc_id", "part", "mask", "n")), strict=True):
            name = digest.hex()
            known = texts.get(name)
            if known is None or doc_id < known[0]:
                if known is not None:
                    for p, k in known[2].items():
                        out += [(known[0], True, p, mask, -k), (known[0], True, p, mask | REPEATED, k)]
                texts[name] = known = [doc_id, mask, {}]
            if doc_id == known[0]:
                known[2][part] = known[2].get(part, 0) + n
                out.append((doc_id, True, part, mask, n))
            else:
                out.append((doc_id, True, part, mask | REPEATED, n))
    state.update((_packed(texts),))
    yield pd.DataFrame(out, columns=FIELDS)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents below a path as a stream of files, some at a time."""
    stored = spark.read.parquet(path)
    files = max(1, min(MOST_FILES, -(-len(stored.inputFiles()) // LEAST_BATCHES)))
    # As a pattern, since a stream takes a plain path for a folder, and a table may be one file.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files).parquet(pattern)


def state_keys(n_documents: int) -> int:
    """Keys of the state for about so many documents; a checkpoint goes with the number it was begun with."""
    return max(16, n_documents // TEXTS_PER_KEY)


def changes(documents: DataFrame, checkpoint: str, target: str, keys: int) -> DataFrame:
    """Stream the documents (doc_id, text, lang) that are new since the checkpoint; all changes written to ``target`` so far."""
    spark = documents.sparkSession
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = narrow.mapInArrow(partial(combined, keys=keys), f"key long, digest binary, {CHANGE}")
    found = rows.groupBy("key").applyInPandasWithState(changes_of, CHANGE, "texts binary", "append", GroupStateTimeout.NoTimeout)
    # A stream takes its settings when it starts; the session gets its own back.
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        # Each store would reserve megabytes for its log otherwise.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        running = (
            found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(target).select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "part", "mask", "n")


def mask_counts(changed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that fail exactly the mask's filters; good and toxic ones among them."""
    flags = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("bad"))
    return skew.attach(changed, flags, ["doc_id"], "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit, bits of the earlier filters) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of :func:`mask_counts`."""
    listed = json.dumps([dict(zip(("filter_order", "step", "bit", "before"), s, strict=True)) for s in steps()])
    every = F.from_json(F.lit(listed), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    # A part has at most 32 masks.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(every))

    def total(value: str, holds: Callable[[Column], Column]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(holds(m["mask"]), m[value]).otherwise(F.lit(0).cast("long")))

    bit, before = F.col("bit"), F.col("before")
    removed = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    found = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: (m.bitwiseAND(bit) == 0) & (m.bitwiseAND(before) == 0)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"))
    # 120 rows a window.
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def _sql() -> str:
    """The same table in SQL."""
    listed = ", ".join(f"('{o}', {s}, {b}, {f})" for o, s, b, f in steps())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part,
  (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
  + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + {REPEATED} * coalesce(doc_id > least, false)::INT AS mask FROM w),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS toxic
  FROM m LEFT JOIN flags f ON m.doc_id = f.doc_id GROUP BY part, mask),
steps(filter_order, step, bit, before) AS (VALUES {listed}),
found AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""


@query("op11_filter_audit", _sql())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of each order, by language."""
    path = f"{sf_dir}/documents.parquet"
    changed = changes(
        open_files(spark, path), session.new_path(spark, "audit-checkpoint"), session.new_path(spark, "audit-changes"),
        state_keys(spark.read.parquet(path).count()))
    return audit(mask_counts(changed, spark.read.parquet(f"{sf_dir}/labels.parquet")))
