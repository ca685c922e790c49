"""Token ids in a binary format: frequency-ranked, byte-aligned variable-length codes.

The most frequent id gets rank 0. A rank takes one to four little-endian bytes; two bits of a
*control* byte say how many, four ranks to a control byte, and control and data bytes are kept
apart, so a block is decoded by looking its control bytes up in a table of byte masks.

A *token table* is a folder with two Parquet tables: ``vocabulary`` (rank, id) and ``blocks``, in
ascending document order (bucket, block): document ids and lengths, and the control and data bytes
of about a million ids. Blocks decode independently of each other.

Defined cases: null text is empty (the end id alone); null ids come first; rows with equal ids
follow each other, shorter first; an empty table gives a table without blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.encoder import encoder
from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids of a block, about.
BLOCK_IDS = 1 << 20
BLOCKS = (
    "bucket int, block int, doc_ids array<long>, lengths array<long>, first long, n_ids long, control binary, data binary")

#: For each control byte, which of the 16 bytes of four 32-bit ranks are stored.
MASKS = (np.arange(4) <= (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)[:, :, None]).reshape(256, 16)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes; zero ranks fill the last control byte."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    padded[: len(ranks)] = ranks
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 16)[MASKS[control]].tobytes()


def decode_ranks(control: bytes, data: bytes) -> np.ndarray:
    """Ranks, with those that fill the last control byte."""
    masks = MASKS[np.frombuffer(control, np.uint8)]
    found = np.zeros(masks.shape, np.uint8)
    if int(masks.sum()) != len(data):
        raise ValueError("control and data bytes don't belong together")
    found[masks] = np.frombuffer(data, np.uint8)
    return found.reshape(-1).view("<u4")


def encoded(documents: DataFrame, tokenizer: str, keeps_space: bool = True) -> DataFrame:
    """Ids of all documents as compressed chunks, written: doc_ids, lengths, ids."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, keeps_space), np.array([END_ID], "<u4").tobytes()
        packer = zstandard.ZstdCompressor(level=3)
        for batch in row_slices(batches):
            ids = [x + end for x in own.encode(batch.column(1).to_pylist())]
            joined = np.frombuffer(b"".join(ids), "<u4")
            narrow = joined.astype("<u2") if joined.max(initial=0) <= 0xFFFF else joined
            lengths = [len(x) // 4 for x in ids]
            yield pa.record_batch({
                "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())), "width": pa.array([narrow.itemsize], pa.int32()),
                "ids": pa.array([packer.compress(narrow.tobytes())], pa.binary())})

    schema = "doc_ids array<long>, lengths array<long>, width int, ids binary"
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return session.materialise(narrow.mapInArrow(chunks, schema), "token-chunks")


def _chunk_ids(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(row["ids"]), "<u2" if row["width"] == 2 else "<u4").astype(np.int64)


def ranked_vocabulary(chunks: DataFrame) -> DataFrame:
    """(rank, id) of the ids that occur, the most frequent first; one row per id of the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in row_slices(batches, 1):
            for row in batch.to_pylist():
                times = np.bincount(_chunk_ids(row))
                if len(times) > len(held):
                    held, times = times, held
                held[: len(times)] += times
        found = np.flatnonzero(held)
        yield pa.record_batch({"id": pa.array(found), "times": pa.array(held[found])})

    counts = chunks.select("width", "ids").mapInArrow(count, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))
    # As many rows as the vocabulary has ids: one task may number them.
    return counts.select((F.row_number().over(Window.orderBy(F.desc("times"), "id")) - 1).cast("long").alias("rank"), "id")


def write_tokens(documents: DataFrame, tokenizer: str, path: str, keeps_space: bool = True) -> None:
    """Encode every whole text (columns doc_id, text), an end id after each, and write a token table to ``path``."""
    spark = documents.sparkSession
    chunks = encoded(documents, tokenizer, keeps_space)
    ranked_vocabulary(chunks).coalesce(1).write.parquet(f"{path}/vocabulary")
    known = spark.read.parquet(f"{path}/vocabulary").toArrow()
    ids, ranks = known.column("id").to_numpy(), known.column("rank").to_numpy()
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, "<u4")
    rank_of[ids] = ranks
    n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = [i / n_buckets for i in range(1, n_buckets)]
    bounds = (documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), share or [0.5]).alias("q")).first()["q"] or []) if share else []
    shared = spark.sparkContext.broadcast((rank_of, np.array(sorted(set(bounds)), np.int64)))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, bounds = shared.value
        for batch in row_slices(batches, 1):
            for row in batch.to_pylist():
                ranks, control, data, at = rank_of[_chunk_ids(row)], [], [], 0
                for length in row["lengths"]:
                    pair = encode_ranks(ranks[at : at + length])
                    control.append(pair[0]), data.append(pair[1])
                    at += length
                key = np.array([-(1 << 63) if d is None else d for d in row["doc_ids"]], np.int64)
                yield pa.record_batch({
                    "bucket": pa.array(np.searchsorted(bounds, key).astype(np.int32)), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "length": pa.array(row["lengths"], pa.int64()), "control": pa.array(control, pa.binary()), "data": pa.array(data, pa.binary())})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order, joined up to blocks within their bucket."""
        bucket, block, first, held = None, 0, 0, []

        def out() -> pa.RecordBatch:
            size = sum(r[1] for r in held)
            values = [[bucket], [block], [[r[0] for r in held]], [[r[1] for r in held]], [first], [size],
                      [b"".join(r[2] for r in held)], [b"".join(r[3] for r in held)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["bucket", "block", "doc_ids", "lengths", "first", "n_ids", "control", "data"]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        size = 0
        for batch in row_slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "length", "control", "data")), strict=True):
                if held and (row[0] != bucket or size >= BLOCK_IDS):
                    yield out()
                    block, first, held = block + 1, first + size, []
                    size = 0
                if row[0] != bucket:
                    bucket, block, first = row[0], 0, 0
                held.append(row[1:])
                size += row[2]
        if held:
            yield out()

    rows = chunks.mapInArrow(codes, "bucket int, doc_id long, length long, control binary, data binary")
    ordered = rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "length", "data")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token table: doc_id, start (ids of all documents before it), ids (as bytes, unsigned 32-bit)."""
    known = spark.read.parquet(f"{path}/vocabulary").toArrow()
    ids = np.zeros(known.num_rows, "<u4")
    ids[known.column("rank").to_numpy()] = known.column("id").to_numpy()
    shared = spark.sparkContext.broadcast(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1):
            for row in batch.to_pylist():
                found = shared.value[decode_ranks(row["control"], row["data"])].tobytes()
                starts, texts, at, start = [], [], 0, row["first"]
                for length in row["lengths"]:
                    texts.append(found[4 * at : 4 * (at + length)])
                    starts.append(start)
                    at, start = at + -(-length // 4) * 4, start + length
                yield pa.record_batch({
                    "bucket": pa.array([row["bucket"]] * len(texts), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "within": pa.array(starts, pa.int64()), "ids": pa.array(texts, pa.binary())})

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(decode, "bucket int, doc_id long, within long, ids binary")
    return rows.join(F.broadcast(_bucket_starts(blocks)), "bucket").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "ids")


def _bucket_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each bucket; there are as many buckets as the session has shuffle partitions, at most."""
    sizes = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids and read the files back."""
    path = session.new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), path)

    return read_tokens(spark, path).select(
        "doc_id", "start", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
