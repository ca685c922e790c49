"""Searches over several lines, null keys, literal unknown values and the shared folder."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from rankspark import session
from rankspark.operators import dictionary, groups, records, sampling, skew
from rankspark.sources import logs


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id int, k string")


def search(uid, items, page_items):
    query = json.dumps({"g_disp_query": "q", "g_uid": "7"})
    pages = [items[i : i + page_items] for i in range(0, len(items), page_items)]
    return [(uid, p, query, json.dumps(page)) for p, page in enumerate(pages)]


def items(n, missing=()):
    return [
        {"p_show_pos": str(i), "p_impression_id": f"i{i}", "p_label": "1", "p_ltrfeatures": "null" if i in missing else "1:2"}
        for i in range(n)
    ]


def log_of(spark, *searches):
    return spark.createDataFrame([x for s in searches for x in s], "search_key string, page int, query_info string, poi_info string")


@pytest.mark.parametrize("page_items", [3, 1000])
def test_a_search_may_span_lines(spark, page_items):
    whole = records.samples(log_of(spark, search("s", items(1500), page_items))).select("group_len").collect()
    assert len(whole) == 1500 and {r.group_len for r in whole} == {1500}
    log = log_of(spark, search("s", items(1500, missing=[1200]), page_items), search("t", items(4), page_items))
    assert {r.search_uid for r in records.samples(log).select("search_uid").collect()} == {"t"}


def test_null_keys_keep_their_rows(nulls):
    assert {(r.id, r.group_len) for r in groups.with_group_length(nulls, "k").collect()} == {(i, 2) for i in range(1, 5)}
    assert {(r.id, r.p) for r in skew.sorted_positions(nulls, ["k"], [F.col("id")], "p").collect()} == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert {(r.id, r.p) for r in skew.group_positions(nulls, ["k"], [F.col("id")], "p").collect()} == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert sampling.stratified_folds(nulls, "k", F.col("id"), 2).count() == 4
    assert sampling.stratified_quarter(nulls, "k", F.col("id"), "a").count() == 4


def test_runs_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, None)], "i int, c string")
    got = sorted((r.start, r.c, r.n) for r in groups.runs(rows, "c", [F.col("i")]).collect())
    assert got == [(1, None, 2), (3, "a", 1), (4, None, 1)]


def test_a_literal_unknown_value_keeps_rows_single(spark):
    rows = spark.createDataFrame([("UNK",), ("x",), ("x",)], "v string")
    counts = dictionary.value_counts(rows, {"f": [F.col("v")]}).unionByName(dictionary.unknown_rows(rows, ["f"]))
    ids = dictionary.number(counts)
    got = dictionary.look_up(rows, ids, {"id": ("v", "f")}).collect()
    assert sorted((r.v, r.id) for r in got) == [("UNK", 1), ("x", 2), ("x", 2)]


def test_a_small_field_is_broadcast_beside_a_large_one(spark):
    ids = spark.range(400_000).select(F.lit("uid").alias("dict_key"), F.sha2(F.col("id").cast("string"), 256).alias("value"), F.col("id").cast("int").alias("idx"))
    ids = ids.unionByName(spark.createDataFrame([("side", "0", 1), ("side", "1", 2)], "dict_key string, value string, idx int"))
    rows = spark.range(10).select((F.col("id") % 2).alias("side"))
    plan = dictionary.look_up(rows, ids, {"side_id": ("side", "side")})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_scan_lists_only_the_days_asked_for(spark):
    path = session.new_path(spark, "log")
    rows = spark.createDataFrame([(1, date(2023, 3, 23), "BR"), (2, date(2023, 3, 24), "BR"), (3, date(2023, 3, 25), "MX")], "a int, dt date, country_code string")
    logs.write_log(rows, path)
    scan = logs.scan_log(spark, path, "2023-03-24", "2023-03-25")
    assert {r.a for r in scan.collect()} == {2, 3}
    assert all("2023-03-23" not in f for f in scan.inputFiles())
    assert {r.a for r in logs.scan_log(spark, path, "2023-03-23", "2023-03-25", skip_days=logs.BAD_DAYS).collect()} == {1, 3}
    assert logs.scan_log(spark, path, "2020-01-01", "2020-01-02").count() == 0


def test_no_temporary_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
