"""Vector codes against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, n_entries=16, rounds=6):
    """{(vec_id, vector, label): (code, error)} and the books' digest, with Python's integers alone."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    step = width // parts
    whole = [[math.floor(x * 4096) if abs(x) < 2**40 else int(x) * 4096 for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = [[v[p * step : (p + 1) * step] for v in whole] for p in range(parts)]
    books = [c[:n_entries] for c in cut]

    def assign():
        out = []
        for p in range(parts):
            out.append([min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[p])) for v in cut[p]])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v for v, (_, i) in zip(cut[p], found[p], strict=True) if i == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    text = ",".join(str(x) for part in books for e in part for x in e)
    rows = [(r[0], "".join(f"{found[p][n][1]:02x}" for p in range(parts)), sum(found[p][n][0] for p in range(parts)), r[2]) for n, r in enumerate(kept)]
    return rows, hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(40)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(i, rows[7][1], 2) for i in (7, 400, 401)]
    rows += [(402, None, 0), (403, [], 1), (404, [1.0, None], 0), (405, [float("nan")] * 40, 0), (406, [float("-inf")] * 40, 0)]
    rows += [(None, [0.25] * 40, None), (None, [0.25] * 40, None), (407, [0.5] * 7, 3), (408, [-0.0] * 40, 3)]
    return rows


def test_same_as_plain_integers(spark, odd_vectors):
    df = spark.createDataFrame(odd_vectors, SCHEMA).withColumns({"code": F.lit("other"), "ERROR": F.lit("x"), "total": F.lit(1.5)}).repartition(5)
    vectors = vector_codes.kept_vectors(df)
    books = vector_codes.fit(vectors)
    found = vector_codes.with_label_errors(vector_codes.encoded(vectors, books)).collect()
    want, digest = plain(odd_vectors)
    assert books.sha256 == digest
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.vec_id, r.code, r.error, r.label) for r in found], key=key) == sorted(want, key=key)
    totals = {}
    for _, _, error, label in want:
        totals[label] = totals.get(label, 0) + error
    assert all(r.label_error == totals[r.label] and r.total == 1.5 for r in found)


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e30, -3e38, 12345.678, 2.0**45]) * rng.random() for _ in range(16)], 0) for i in range(40)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    books = vector_codes.fit(vectors, rounds=3)
    want, digest = plain(rows, rounds=3)
    assert books.sha256 == digest
    found = {r.vec_id: (r.code, r.error) for r in vector_codes.encoded(vectors, books).collect()}
    assert found == {i: (code, error if error < 1 << 63 else None) for i, code, error, _ in want}


def test_few_rows_and_none(spark):
    rows = [(2, [1.0, 2.0], 0), (1, [3.0, 4.0], 0)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    books = vector_codes.fit(vectors)
    assert [len(e) for e in books.entries] == [2] * 8 and books.sha256 == plain(rows)[1]
    assert {r.vec_id: r.code for r in vector_codes.encoded(vectors, books).collect()} == {i: c for i, c, _, _ in plain(rows)[0]}
    none = vectors.limit(0)
    assert vector_codes.with_label_errors(vector_codes.encoded(none, vector_codes.fit(none))).collect() == []


@pytest.mark.parametrize("length", [1, 2, 8, 32])
def test_transform_is_in_sequency_order_and_keeps_distances(length):
    basis = vector_codes.transformed(np.eye(length, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in basis] == list(range(length))
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (20, length))
    assert ((vector_codes.transformed(rows) ** 2).sum(1) == length * (rows**2).sum(1)).all()


def test_nearest_takes_the_lower_index_of_ties():
    rows = np.random.default_rng(2).integers(-3, 3, (500, 6))
    entries = np.random.default_rng(3).integers(-3, 3, (16, 6))
    distance = ((rows[:, None] - entries) ** 2).sum(2)
    code, error = vector_codes.nearest(rows, entries)
    assert (code == distance.argmin(1)).all() and (error == distance.min(1)).all()
