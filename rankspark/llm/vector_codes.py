"""Vector codes: each part of a vector is named by its nearest codebook entry, all in integers.

The parts and the entries are filled up with zeros to a power of two and passed through an integer
Walsh-Hadamard transform. It keeps squared distances up to a fixed factor (the padded length), and
most of a difference shows in the first coefficients when they are taken in sequency order. So the
squared differences are added up coefficient by coefficient; an entry whose sum already exceeds the
whole distance of the entry that led after the first coefficients is dropped. What is left at the
end has its exact (scaled) distance; nothing is rounded.

Each round broadcasts the codebooks (parts x entries x positions, independent of the data), and a
task passes on one sum per part, entry and position. Sums travel in limbs of 60 bits and are added
as decimals, so they are exact at any number of rows.

Defined cases: vectors that are null or hold null or non-finite components are dropped; null ids
count as larger than all others and are rows like any other, as are repeated ids (equal ids are
taken in the order of their vectors); shorter vectors, and a width that the parts don't divide, are
filled up with zeros; with fewer rows than entries there are as many entries as rows; components of
any finite size are exact (beyond the range of 64-bit sums in Python's integers); an error or label
error beyond a long is null; null labels are a label; an empty table gives an empty result; other
columns are kept by ``encoded`` unless they bear the names of its results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import free_name, row_slices, table
from rankspark.operators import skew

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Coefficients that are added up for all entries before the first ones are dropped.
LEADING = 2
#: Bits of a limb of a sum.
LIMB = 60
#: Components below this bound are scaled in floating point without loss, larger ones are whole already.
EXACT = float(1 << 40)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor holds a null or non-finite component."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~odd)


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where those would be too small."""
    if not values.size or np.abs(values).max() < EXACT:
        return np.floor(values * scale).astype(np.int64)
    whole = [math.floor(x * scale) if abs(x) < EXACT else int(x) * scale for x in values.reshape(-1).tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def part_rows(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """Vectors of an Arrow list column as integers (rows, parts, positions), filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), width))
    rows[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy().astype(float)
    return integers(rows, scale).reshape(len(sizes), parts, width // parts)


def sequency_order(length: int) -> np.ndarray:
    """Index, in the natural order of a Hadamard transform, of the coefficient with 0, 1, 2, ... sign changes."""
    bits = length.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(length)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transformed(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients along the last axis, in sequency order; it is filled up to a power of two."""
    length = 1 << max(rows.shape[-1] - 1, 0).bit_length()
    out = np.zeros((*rows.shape[:-1], length), rows.dtype)
    out[..., : rows.shape[-1]] = rows
    half = 1
    while half < length:
        pairs = out.reshape(*rows.shape[:-1], length // (2 * half), 2, half)
        left, right = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([left + right, left - right], axis=-2).reshape(*rows.shape[:-1], length)
        half *= 2
    return out[..., sequency_order(length)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index. Integers (n, d) and (k, d)."""
    length = 1 << max(rows.shape[1] - 1, 0).bit_length()
    largest = max((int(np.abs(x).max()) for x in (rows, entries) if x.size), default=0)
    # The scaled sum of squares is at most length^3 * (2 * largest)^2.
    kind = np.int64 if rows.dtype != object and entries.dtype != object and 4 * length**3 * largest**2 < 1 << 62 else object
    left, right = transformed(rows.astype(kind)), transformed(entries.astype(kind))
    first = min(LEADING, length)
    so_far = np.zeros((len(left), len(right)), kind)
    for s in range(first):
        so_far += (left[:, s, None] - right[None, :, s]) ** 2
    leader = so_far.argmin(axis=1)
    bound = ((left - right[leader]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= bound[:, None])
    total = so_far[row, entry]
    for s in range(first, length):
        total = total + (left[row, s] - right[entry, s]) ** 2
        alive = (total <= bound[row]).astype(bool)
        row, entry, total = row[alive], entry[alive], total[alive]
    # The remaining entries of a row stand together, by ascending index; the leader is always among them.
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    least = np.minimum.reduceat(total, starts) if len(row) else total
    hits = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    best = hits[np.flatnonzero(np.r_[True, row[hits][1:] != row[hits][:-1]])] if len(row) else hits
    return entry[best], total[best] // length


def _limbs(value: int) -> list[int]:
    """``value`` by powers of 2^LIMB; the last limb bears the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class Codebooks:
    """Entries of every part: a list of integer arrays (entries, positions), one per part."""

    def __init__(self, entries: list[np.ndarray], width: int, scale: int = SCALE):
        self.entries, self.width, self.scale = entries, width, scale

    @property
    def sha256(self) -> str:
        numbers = (str(int(x)) for part in self.entries for row in part for x in row)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def first_codebooks(vectors: DataFrame, parts: int = PARTS, n_entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the rows with the smallest ids."""
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-size // parts) * parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(n_entries).select("embedding").toArrow().column(0).combine_chunks()
    rows = part_rows(first, width, parts, scale)
    return Codebooks([rows[:, p] for p in range(parts)], width, scale)


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, which becomes the floor of their mean."""
    spark = vectors.sparkSession
    parts = len(books.entries)
    shared = spark.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        totals = [np.zeros(e.shape, object) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in row_slices(batches, 2048):
            if not batch.num_rows:
                continue
            rows = part_rows(batch.column(0), books.width, parts, books.scale)
            for p, entries in enumerate(books.entries):
                code, _ = nearest(rows[:, p], entries)
                # Sums of one batch fit 64 bits if its components do; over batches Python's integers go on.
                small = rows.dtype != object and (not rows.size or int(np.abs(rows).max()) < 1 << 50)
                one = np.zeros(entries.shape, np.int64 if small else object)
                np.add.at(one, code, rows[:, p])
                totals[p] += one
                counts[p] += np.bincount(code, minlength=len(entries))
        out = [
            (p, e, at, nth, limb)
            for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()
            for at, value in enumerate([int(counts[p][e]), *map(int, totals[p][e])], -1) for nth, limb in enumerate(_limbs(value))]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "nth", "limb"])

    found: dict[tuple[int, int, int], int] = {}
    rows = vectors.select("embedding").mapInArrow(sums, "part long, entry long, at long, nth long, limb long")
    for part, entry, at, nth, total in rows.groupBy("part", "entry", "at", "nth").agg(F.sum(F.col("limb").cast("decimal(38,0)"))).collect():
        found[part, entry, at] = found.get((part, entry, at), 0) + (int(total) << LIMB * nth)
    shared.unpersist()
    new = []
    for p, entries in enumerate(books.entries):
        rows = [
            [found[p, e, at] // found[p, e, -1] for at in range(entries.shape[1])] if (p, e, -1) in found else [int(x) for x in entries[e]]
            for e in range(len(entries))]
        large = any(abs(x) >= 1 << 62 for row in rows for x in row)
        new.append(np.array(rows, object if large else np.int64).reshape(entries.shape))
    return Codebooks(new, books.width, books.scale)


def fit(vectors: DataFrame, parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after the rounds; a round that changes nothing ends them, as all later ones would."""
    books = first_codebooks(vectors, parts, n_entries, scale)
    for _ in range(rounds if books.width and len(books.entries[0]) else 0):
        last, books = books, refined(vectors, books)
        if last.sha256 == books.sha256:
            break
    return books


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The rows without their vector, with ``code`` (two hex digits per part) and ``error``."""
    parts = len(books.entries)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    others = [c for c in vectors.columns if c.lower() not in ("embedding", "code", "error")]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in row_slices(batches, 2048):
            found, errors = [], [0] * batch.num_rows
            if batch.num_rows:
                rows = part_rows(batch.column(batch.num_columns - 1), books.width, parts, books.scale)
                for p, entries in enumerate(books.entries):
                    code, distance = nearest(rows[:, p], entries)
                    found.append(code)
                    errors = [a + int(b) for a, b in zip(errors, distance.tolist(), strict=True)]
            names = ["".join(f"{c:02x}" for c in row) for row in np.stack(found, 1).tolist()] if found else []
            errors = [e if e < 1 << 63 else None for e in errors]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(errors, pa.int64())], [*batch.schema.names[:-1], "code", "error"])

    rows = vectors.select(*[vectors[c] for c in others], "embedding")
    schema = StructType([*rows.drop("embedding").schema, StructField("code", StringType()), StructField("error", LongType())])
    return rows.mapInArrow(codes, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of the same label (null is one)."""
    rows = session.materialise(coded.drop("label_error"), "codes")
    name = free_name(rows, "total")
    totals = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias(name))
    return skew.attach(rows, totals, ["label"]).withColumn("label_error", F.col(name).try_cast("long")).drop(name)


def _sql() -> str:
    """The same rounds in SQL."""
    assign = lambda books: f"""
SELECT p.rid, p.part, p.v, b.entry, list_sum(list_transform(p.v, lambda x, i: (x - b.v[i]) * (x - b.v[i]))) AS d
FROM parts p JOIN {books} b ON p.part = b.part
QUALIFY row_number() OVER (PARTITION BY p.rid, p.part ORDER BY d, b.entry) = 1"""  # noqa: E731
    rounds = "".join(f"""
a{r} AS ({assign(f"b{r}")}),
s{r} AS (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM
  (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL),
n{r} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM s{r} GROUP BY part, entry),
b{r + 1} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry),""" for r in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(part)),
b0 AS (SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= {ENTRIES}),{rounds}
last AS ({assign(f"b{ROUNDS}")}),
codes AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rid), books
"""


@query("op12_vector_codes", _sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, by codebooks fitted on all of them."""
    vectors = session.materialise(kept_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")), "vectors")
    books = fit(vectors)
    return with_label_errors(encoded(vectors, books)).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
