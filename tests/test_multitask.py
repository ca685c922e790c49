"""The multi-task pair job: buckets, hot searches, look-ups of large fields."""

import random

import pytest
from pyspark.sql import functions as F

from rankspark.functions import features, text
from rankspark.operators import dictionary, encoding, skew
from rankspark.plans import jobs

GROUP, ITEM = ["query"], ["item", "f1"]


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        s = "hot" if i < 400 else rng.choice([f"s{i % 60}", None])
        rows.append((s, f"q-{s}", i, float(i % 7), "click", rng.choice([0, 1, 2])))
        if s in ("hot", "s3", "s4", "s50") or (s and rng.random() < 0.2):
            rows.append((s, f"q-{s}", i, float(i % 7), "order", rng.choice([1, 2])))
    rows += [("only-ordered", "q", 5000, 0.0, "order", 2), ("only-ordered", "q", 5001, 0.0, "order", 1)]
    return rows


@pytest.fixture(scope="module")
def rows(spark, log):
    return spark.createDataFrame(log, "search_uid string, query string, item long, f1 double, data_type string, label int").repartition(5)


def plain(log, test):
    out, searches = [], {}
    for s, q, item, f1, kind, label in log:
        if s is not None:
            searches.setdefault(s, {"click": [], "order": []})[kind].append((q, item, f1, label - 1, label - 1 if kind == "order" else 0))
    for s, kinds in searches.items():
        if test:
            out += [(s, len(kinds["order"]), "order", r[0], *r[1:], *r[1:]) for r in kinds["order"]]
        elif kinds["click"]:
            kind = "order" if kinds["order"] else "click"
            own = kinds[kind]
            out += [(s, len(own), kind, p[0], *p[1:], *n[1:]) for p in own if p[3] == 1 for n in own if n[3] != 1]
    return sorted(out)


@pytest.mark.parametrize("test", [False, True])
@pytest.mark.parametrize("hot_rows", [300, 10**9])
def test_pairs_same_as_plain(rows, log, hot_rows, test):
    ordinary, hot = jobs.search_buckets(rows, "search_uid", hot_rows)
    assert (hot is not None) == (hot_rows == 300)
    got = jobs.multitask_pairs((ordinary, hot), "search_uid", GROUP, ITEM, test)
    names = ["search_uid", "group_len", "data_type", "query", *[f"{s}_{c}" for s in ("pos", "neg") for c in (*ITEM, "click_label", "order_label")]]
    assert sorted(tuple(r) for r in got.select(names).collect()) == plain(log, test)


def test_nothing_above_the_buckets_is_exchanged(spark, rows):
    buckets = jobs.search_buckets(rows, "search_uid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for test in (False, True):
            plan = jobs.multitask_pairs(buckets, "search_uid", GROUP, ITEM, test)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def coded(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(50)]
    rows = [(i, rng.choice([*words, None, "new"]), rng.choice(words[:20]), rng.choice(["x", "y", "zz"]), rng.choice(["7", "123456789", "abcdefghi"])) for i in range(400)]
    ids = [("a", w, n + 1) for n, w in enumerate(words)] + [("a", "UNK", 99), ("b", "x", 1), ("uid", "7", 5), ("uid", "UNK", 6)]
    return spark.createDataFrame(rows, "id int, p string, q string, r string, u string"), spark.createDataFrame(ids, "dict_key string, value string, idx int")


FIELDS = {"p_id": ("p", "a"), "q_id": ("q", "a"), "r_id": ("r", "b"), "u_id": ("u", "uid")}


def test_large_fields_meet_the_dictionary_together(coded):
    rows, ids = coded
    want = sorted(tuple(r) for r in dictionary.look_up(rows, ids, FIELDS).collect())
    melted = dictionary.look_up(rows, ids, FIELDS, broadcast_entries=3)
    assert sorted(tuple(r) for r in melted.collect()) == want
    known = {(r.dict_key, r.value): r.idx for r in ids.collect()}
    for r in melted.collect():
        assert r.p_id == known.get(("a", r.p), 99) and r.q_id == known.get(("a", r.q), 99) and r.r_id == known.get(("b", r.r), 0)
        assert r.u_id == (5 if r.u == "7" else 123456789 % 100_000_000 % features.USER_BUCKETS if r.u.isdigit() else None)


def test_one_exchange_of_the_rows_for_two_large_fields(spark, coded):
    rows, ids = coded
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = rows.withColumn("payload", F.lit("kept"))
        plan = dictionary.look_up(wide, ids, FIELDS, broadcast_entries=3)._jdf.queryExecution()
        lines = plan.optimizedPlan().toString().count("payload") and plan.executedPlan().toString()
        exchanges = [x for x in lines.split("\n") if "Exchange hashpartitioning" in x]
        # The dictionary, the melted values, their ids by row, and the rows; not the rows once per field.
        assert len(exchanges) == 4, lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_list_ids(spark, coded):
    _, ids = coded
    rows = spark.createDataFrame([(1, "v1 v2 nope v3 v4"), (2, ""), (3, None), (4, "v1 v2 nope v3 v4")], "id int, t string")
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    got = {r.id: r.x for r in encoding.list_ids(rows, {"x": ("t", "a", split, 4)}, ids).collect()}
    assert got == {1: [2, 3, 99, 4], 2: [0] * 4, 3: [0] * 4, 4: [2, 3, 99, 4]}


def test_items_have_every_column_of_the_format(spark):
    rows = spark.createDataFrame(
        [("s", "blue cafe", "Blue Cafe|Main St 5", 1, 2, "2020-01-01 13:00:00", 1, 10, "a;b", 3, 0, {1: 4.0, 2: 6.0})],
        "search_uid string, query string, name_address string, uid int, city_id int, time_text string, query_type int, poi_id int, category string, layer int, "
        "show_pos int, f map<int,double>")
    counts = dictionary.value_counts(rows, {"trigram": [text.char_trigrams(F.col("query"))], "uid": [F.col("uid")], "category": [F.split("category", ";")]})
    ids = dictionary.number(counts)
    vocabulary = encoding.build_vocabulary(rows, "name_address")
    out = jobs.multitask_items(rows, ids, vocabulary, {1: (2.0, 4.0), 2: (1.0, 0.0)}, {"top": [1, 2, 3, 0]}).first().asDict()
    assert set(jobs.MULTITASK_QUERY + jobs.MULTITASK_ITEM) <= set(out)
    assert out["top"] == [0.5, 0.0, 0.0, 0.0] and out["category_ids"] == [1, 2] + [0] * 8 and out["component_ids"] == [0] * 10
    assert [len(out[c]) for c in ("query_trigrams", "name_trigrams", "token_ids", "segment_ids", "mask_ids")] == [32] * 5
    assert out["query_trigrams"][:7] != [0] * 7 and out["query_trigrams"][7:] == [0] * 25


def test_split_hot_keeps_every_keyed_row(rows):
    ordinary, hot = skew.split_hot(rows, "search_uid", 300)
    assert {r.search_uid for r in hot.select("search_uid").distinct().collect()} == {"hot"}
    assert ordinary.count() + hot.count() == rows.where("search_uid is not null").count()


def test_lists_are_made_once_for_each_pair_of_texts(spark, monkeypatch):
    texts = [("blue cafe", "Blue Cafe|Main St 5"), (None, "Blue Cafe|Main St 5"), ("blue cafe", None)]
    rows = spark.createDataFrame(
        [("s", *texts[i % 3], 1, 2, "2020-01-01 13:00:00", 1, i, "a;b", 3, 0, {1: 4.0}) for i in range(12)],
        "search_uid string, query string, name_address string, uid int, city_id int, time_text string, query_type int, poi_id int, category string, layer int, "
        "show_pos int, f map<int,double>")
    ids = dictionary.number(dictionary.value_counts(rows, {"trigram": [text.char_trigrams(F.col("query"))]}))
    encoded, real = [], encoding.with_ids
    monkeypatch.setattr(encoding, "with_ids", lambda df, *rest: encoded.append(df.count()) or real(df, *rest))
    vocabulary = encoding.build_vocabulary(rows, "name_address")
    plain = {r.poi_id: r for r in jobs.multitask_items(rows, ids, vocabulary, {}, {}).collect()}
    shown = {r.poi_id: r for r in jobs.multitask_items(rows, ids, vocabulary, {}, {}, form=lambda c: F.array_join(c.cast("array<string>"), ",")).collect()}
    assert encoded == [3, 3] and sorted(plain) == sorted(shown) == list(range(12))
    for i, r in plain.items():
        assert all(shown[i][c] == ",".join(map(str, r[c])) and len(r[c]) == 32 for c in jobs.MULTITASK_TEXT)
        assert (r.query_trigrams == [0] * 32) == (r.query is None) and (r.name_trigrams == [0] * 32) == (r.name_address is None)
