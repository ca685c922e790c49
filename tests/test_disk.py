"""What is written or exchanged on the way: only used columns, once, and no longer than needed."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankspark import catalog, session
from rankspark.catalog import jobs as job_queries
from rankspark.operators import encoding, groups, skew
from rankspark.plans import jobs as plans
from rankspark.sources import tables


def test_positions_of_hot_groups_equal_those_of_ordinary_ones(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a" if i < 40 else f"k{i % 5}") for i in range(90)], "id int, k string")
    got = [sorted(map(tuple, skew.group_positions(rows, ["k"], [F.desc("id")], "p", n).select("id", "p").collect())) for n in (8, skew.HOT_ROWS)]
    assert got[0] == got[1] and len(got[0]) == 90


def test_first_items_of_hot_groups_equal_those_of_ordinary_ones(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a" if i < 40 else f"k{i % 5}", i % 3) for i in range(90)], "id int, k string, item int")
    found = lambda n: sorted(map(str, groups.dedup_items(rows, "k", "item", [F.col("id")], n).collect()))
    assert found(8) == found(skew.HOT_ROWS) and len(found(8)) == 21


def exchanges(df, kind="hashpartitioning"):
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange {kind}")


def test_groups_are_gathered_with_one_exchange(spark):
    rows = spark.range(500).select("id", (F.col("id") % 50).alias("k"))
    assert exchanges(groups.gather(rows, ["k"], [F.col("id")], F.col("id"), page_rows=4)) == 1


def test_first_items_and_lengths_take_one_exchange(spark):
    rows = spark.range(500).select("id", (F.col("id") % 50).alias("k"), (F.col("id") % 3).alias("item"))
    assert exchanges(groups.dedup_items(rows, "k", "item", [F.col("id")])) == 1


@pytest.mark.parametrize("query, columns", [
    ("collect_group", {"search_uid", "show_pos", "impression_id"}), ("dedup_items", {"search_uid", "layer", "show_pos", "impression_id"}),
    ("hard_negative_slice", {"uid", "impression_id", "score"})])
def test_only_used_columns_are_written(spark, small, monkeypatch, query, columns):
    written, real = [], session.materialise
    for module in (skew, groups):
        monkeypatch.setattr(module, "materialise", lambda df, label="table": written.append((label, set(df.columns))) or real(df, label))
    catalog.load()[0][query](spark, small)
    assert [c for label, c in written if label == "rows"] == [columns]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    before = spark.conf.get(session.FREE_SHUFFLES, None)
    with session.scratch(spark):
        gone = session.materialise(spark.range(5).repartition(3), "gone")
        with session.kept():
            left = session.materialise(gone.where("id > 1"), "left")
    exists = lambda df: Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).exists()
    assert left.count() == 3 and exists(left) and not exists(gone)
    assert spark.conf.get(session.FREE_SHUFFLES, None) == before


def shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {Path(f).name for f in folder.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_shuffle_files_of_a_written_table_go(spark):
    before = shuffle_files(spark)
    session.materialise(spark.range(1000).repartition(4, "id"), "rows")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            return
        time.sleep(0.1)
    pytest.fail("shuffle files were left")


def test_items_and_users_are_joined_before_the_rows(spark, small):
    own = job_queries._located(spark, small)
    wide = own._jdf.queryExecution().optimizedPlan().toString()
    # The outermost join brings the rows to their searches; nothing deals them out after it.
    assert "l_orderkey" in next(line for line in wide.split("\n") if "Join Inner" in line)
    assert own.count() == tables.impressions(spark, small).count()


def left_by(spark, make):
    """Labels of the tables that ``make`` leaves in the shared folder."""
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    make()
    return sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)


def test_pair_jobs_leave_only_rows_with_used_columns(spark, small, monkeypatch):
    written, real = [], session.materialise
    monkeypatch.setattr(plans, "materialise", lambda df, label="table": written.append(df.columns) or real(df, label))
    assert left_by(spark, lambda: job_queries.job_pair_samples(spark, small)) == ["per-key", "ready"]
    assert written == [["search_uid", "show_pos", "impression_id", "uid_id", "poi_idx", "layer_id", "leaves", "tree_score", "scaled", "label"]]


def test_multitask_buckets_are_all_that_stays(spark, small):
    assert left_by(spark, lambda: job_queries.job_multitask_pairs(spark, small)) == ["searches"]


def test_term_counts_go_when_documents_are_summed(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", "a b a"), (2, "en", "s", "b c")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    assert left_by(spark, lambda: made.append(catalog.load()[0]["tfidf_terms"](spark, str(tmp_path)))) == ["totals", "totals"]
    assert sorted((r.doc_id, r.gram, r.n_terms, r.n_words) for r in made[0].collect()) == [(1, 1, 2, 3), (1, 2, 2, 2), (2, 1, 2, 2), (2, 2, 1, 1)]


def test_rows_of_one_text_pair_are_encoded_once(spark, small, monkeypatch):
    seen, real = [], encoding.with_ids
    monkeypatch.setattr(encoding, "with_ids", lambda rows, *rest: seen.append(rows) or real(rows, *rest))
    rows = spark.createDataFrame([(i, "goldenrod", "x|y" if i else None) for i in range(6)], "id int, query string, name_address string")
    got = job_queries._with_tokens(spark, small)(rows).collect()
    assert seen[0].count() == 2 and len(got) == 6 and len({r.token_ids for r in got}) == 2
