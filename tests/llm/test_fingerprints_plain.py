"""Features, filters and likenesses of fingerprints restated in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import fingerprints

ALL = (1 << 64) - 1


def plain_features(text, rank):
    """Places of the windows that are features."""
    if not text:
        return []
    if len(text) < 64:
        return [0]
    ranks = []
    for i in range(len(text) - 63):
        terms = sum(int(fingerprints._TERM[k]) for k in Counter(text[i : i + 64]).values())
        ranks.append(rank[(fingerprints._MOST - terms) * 1000 // fingerprints._MOST])
    votes = Counter(min(range(s, s + 64), key=lambda i: (ranks[i], i)) for s in range(len(ranks) - 63))
    found = sorted(i for i, n in votes.items() if n >= fingerprints.POPULAR)
    if found:
        return found
    return [max(range(len(ranks)), key=lambda i: (votes[i], -i)) if len(ranks) >= 64 else min(range(len(ranks)), key=lambda i: (ranks[i], i))]


def plain_filters(text, rank):
    """Number of features, and the set of bits of each filter."""
    places = plain_features(text, rank)
    padded = text.ljust(64, b"\0")
    filters = []
    for nth, i in enumerate(places):
        if nth % fingerprints.FILTER_FEATURES == 0:
            filters.append(set())
        mixed = 64
        for w in range(8):
            word = int.from_bytes(padded[i + 8 * w : i + 8 * w + 8], "little")
            mixed = (mixed * int(fingerprints._B) & ALL) ^ word
            mixed = (mixed ^ mixed >> 32) * int(fingerprints._A) & ALL
            mixed ^= mixed >> 29
        filters[-1] |= {mixed >> 11 * k & 2047 for k in range(fingerprints.HASHES)}
    return len(places), filters


def plain_text(text, rank):
    n, filters = plain_filters(text, rank)
    return f"{n}:" + "".join(format(sum(1 << 2047 - b for b in f), "0512x") for f in filters)


def plain_likeness(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    best = [max((len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9) for y in b) for x in a]
    return min(1.0, max(0.0, sum(best) / len(a)))


def test_every_column_is_that_of_plain_python(spark):
    rng = random.Random(17)
    base = "".join(rng.choices("abcdefgh ijklmno.,é", k=9_000))
    texts = [base, base[:5000] + "x" + base[5001:], base[100:4100], "".join(rng.choices("ab ", k=3000)), "short", "", None, "y" * 64, "z" * 127, "漢" * 300, base]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"fingerprint": F.lit("other"), "bucket": F.lit(1)})
    rank = fingerprints.level_ranks(df.select("text"))
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert len(got) == len(rows)
    whole = [(t or "") for t in texts]
    prints = [plain_filters(t.encode(), rank)[1] for t in whole]
    for i, t in enumerate(whole):
        following = (i - 1) % len(whole)
        k = len(t) // 3
        new = (t[: len(t) - k] + whole[following][:k]).encode()
        r = got[i]
        assert r.fingerprint == plain_text(t.encode(), rank) and r.edited_fingerprint == plain_text(new, rank)
        assert r.near_edited == pytest.approx(plain_likeness(prints[i], plain_filters(new, rank)[1]))
        assert r.near_next == pytest.approx(plain_likeness(prints[i], prints[following]))
    assert got[0].near_edited > 0.5 and np.isclose(got[10].fingerprint == got[0].fingerprint, True)
