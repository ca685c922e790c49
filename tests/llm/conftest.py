import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, tiny, repeated and long texts, ids that are null, shared lines and near copies."""
    rng = random.Random(11)
    base = [words(rng, 60, 5000) for _ in range(12)]
    shared = "A line that stands in many of the documents, word for word."
    rows = [(i, f"{t}\n  {shared.upper() if i % 2 else shared} \n{t[::-1]}") for i, t in enumerate(base)]
    near = base[0].split()
    for i in range(12, 18):
        changed = list(near)
        changed[i] = f"new{i}"
        rows.append((i, " ".join(changed)))
    rows += [(20, base[3]), (21, base[3]), (22, ""), (23, None), (24, "one"), (25, "One"), (26, "two words"), (27, "\n\n \t\n")]
    rows += [(28, words(rng, 30_000, 3000)), (29, "é" * 400 + " ü|ß.,\x00 漢字 ‘x’ \x1c\xa0…"), (None, base[4]), (None, "of no id"), (30, "x y"), (30, "x y")]
    return [(d, t, "en", f"s{n % 2}", None if t is None else len(t)) for n, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def stored(spark, odd):
    """The odd documents as a table scan."""
    from rankspark.session import materialise

    return materialise(odd, "odd")
