"""Wide rows are joined, parsed and sorted once, and only with the columns that are used."""

import struct

import pytest
from pyspark.sql import functions as F

from rankspark.catalog import aggregates as aggregate_queries
from rankspark.catalog import jobs as job_queries
from rankspark.operators import dictionary, groups, models, records, skew
from rankspark.sources import tables


def log_rows(df):
    return sorted(map(tuple, df.select("search_key", "page", "query_info", "poi_info", "dt", "country_code").collect()))


def test_search_log_of_hot_searches(spark, small):
    assert log_rows(tables.search_log(spark, small, hot_rows=4)) == log_rows(tables.search_log(spark, small))


def test_search_log_writes_no_rows(spark, small, monkeypatch):
    monkeypatch.setattr(skew, "materialise", lambda *_: pytest.fail("rows were written"))
    assert tables.search_log(spark, small).columns[0] == "search_key"


class Seen(Exception):
    pass


@pytest.mark.parametrize("query", ["job_pair_columns", "job_pair_samples", "job_rank_rows"])
def test_jobs_join_their_rows_once(spark, small, monkeypatch, query):
    def counts(rows, values):
        raise Seen(rows.inputFiles())

    monkeypatch.setattr(dictionary, "value_counts", counts)
    with pytest.raises(Seen) as seen:
        getattr(job_queries, query)(spark, small)
    assert not any("lineitem" in f for f in seen.value.args[0])


def test_pair_blocks(spark):
    rows = spark.createDataFrame([(i % 3 - 1, [float(i), -1.0]) for i in range(30)], "task int, d array<double>").coalesce(1)
    blocks = models.pair_blocks(rows, block_pairs=4).collect()
    assert sum(b.n for b in blocks) == 30 and {b.width for b in blocks} == {2} and max(b.n for b in blocks if b.task >= 0) <= 4
    for t in (0, 1):
        values = [v for b in blocks if b.task == t for v in struct.unpack(f"<{2 * b.n}d", b.d)]
        assert sorted(values[::2]) == [float(i) for i in range(30) if i % 3 - 1 == t] and set(values[1::2]) == {-1.0}


def test_rank_rows_gathers_only_items(spark, small, monkeypatch):
    def gather(rows, *_):
        raise Seen(rows.columns)

    monkeypatch.setattr(groups, "gather", gather)
    with pytest.raises(Seen) as seen:
        job_queries.job_rank_rows(spark, small)
    assert seen.value.args[0] == ["search_uid", "show_pos", "impression_id", "item"]


def test_samples_write_their_lines_once(spark, monkeypatch):
    written, real = [], records.materialise
    monkeypatch.setattr(records, "materialise", lambda df, label="table": written.append(label) or real(df, label))
    item = lambda i, f: f'{{"p_show_pos": "{i}", "p_impression_id": "{i}", "p_label": "1", "p_ltrfeatures": "{f}"}}'
    lines = [("a", 0, "{}", f"[{item(1, '1:2')}]"), ("a", 1, "{}", f"[{item(2, '1:3')}]"), ("b", 0, "{}", f"[{item(1, 'null')}]"), ("b", 1, "{}", f"[{item(2, '1:4')}]")]
    log = spark.createDataFrame(lines, "search_key string, page int, query_info string, poi_info string")
    got = records.samples(log).select("search_uid", "p_impression_id", "group_len").collect()
    assert sorted(map(tuple, got)) == [("a", "1", 2), ("a", "2", 2)] and written == ["parsed"]


def test_dedup_search_makes_the_log_once(spark, small):
    plan = aggregate_queries.dedup_search(spark, small)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [l_orderkey") == 1
