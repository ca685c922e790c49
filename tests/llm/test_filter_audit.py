"""The filter audit against a plain count of every order."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm import filter_audit

SPACE = b" \t\n\x0b\x0c\r"


def fails(rows):
    """The set of filters that each row (doc_id, text, lang) fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = text.encode().split()
        own = set()
        if len(words) < 100:
            own.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            own.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            own.add("C")
        if set(text) & set("#$%&*|"):
            own.add("D")
        if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in rows):
            own.add("E")
        out.append(own)
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = fails(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def odd_documents():
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice([20, 2000]))], k=rng.choice([3, 99, 100, 150, 400]))) for _ in range(25)]
    texts += [t.upper() for t in texts[:8]] + [t + rng.choice("#$%&*|") for t in texts[:8]]
    texts += [None, "", "x" * 200_000, "ÀÉ" * 30 + "A" * 6, "\xa0".join("abc" * 40), "a\x0bb\x1cc d"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", "de", None, ""])) for i in range(220)]
    rows += [(rng.randrange(300), texts[0], "en") for _ in range(120)]
    rows += [((1 << 60) + i, texts[3], "en") for i in range(3)] + [((1 << 60) + 9, "of a large id", "en")]
    rows += [(None, texts[0], "en"), (None, texts[0], None), (None, None, "fr"), (5, "once more", "fr"), (5, "once more", "fr"), (-7, texts[1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def written(spark, rows, n_files):
    """The rows as so many files, larger ids first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    path = session.new_path(spark, "odd-documents")
    df = spark.createDataFrame([(*r, n * n_files // len(rows)) for n, r in enumerate(rows)], "doc_id long, text string, lang string, file int")
    for n in range(n_files):
        one = df.where(F.col("file") == n).select("doc_id", "text", "lang", F.lit(1).alias("key"), F.lit("x").alias("mask"), F.lit(2).alias("part"))
        one.coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path, labels, state=None):
    state = state or (session.new_path(spark, "state"), session.new_path(spark, "changes"))
    changed = filter_audit.changes(filter_audit.open_files(spark, path), *state, keys=7)
    return changed, filter_audit.audit(filter_audit.mask_counts(changed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))


def test_same_as_plain_counts_with_retractions(spark, odd_documents, monkeypatch):
    rows, labels = odd_documents
    monkeypatch.setattr(filter_audit, "AROUND", 7)
    path = written(spark, rows, 6)
    changed, table = run(spark, path, labels)
    assert changed.where("n < 0").count() > 0, "smaller ids arrive later, so something must be taken back"
    assert found(table) == plain(rows, labels)


def test_a_later_run_goes_on_with_new_files(spark, odd_documents):
    rows, labels = odd_documents
    first, later = rows[::2], rows[1::2]
    path = written(spark, first, 2)
    state = session.new_path(spark, "state"), session.new_path(spark, "changes")
    assert found(run(spark, path, labels, state)[1]) == plain(first, labels)
    spark.read.parquet(written(spark, later, 1)).write.mode("append").parquet(path)
    assert found(run(spark, path, labels, state)[1]) == plain(rows, labels)


def test_no_rows_and_settings_stay(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    path = session.new_path(spark, "none")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    assert run(spark, path, [(1, 1, 1)])[1].collect() == []
    assert spark.conf.get(name, None) == before


def test_masks():
    many = " ".join(f"w{i}" for i in range(100))
    assert filter_audit.mask_of(b"") == 1 and filter_audit.mask_of(many.encode()) == 0
    assert filter_audit.mask_of((many + " w1" * 25).encode()) == 0 and filter_audit.mask_of((many + " w1" * 26).encode()) == 2
    assert filter_audit.mask_of("ABé é".encode()) == 1 | 4 and filter_audit.mask_of(b"a|") == 1 | 8
    assert filter_audit.mask_of(("é" * 90 + "A" * 10).encode()) == 1 and filter_audit.mask_of(("é" * 89 + "A" * 10).encode()) == 1 | 4
