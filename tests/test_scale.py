"""The forms used for very large groups give the same results as the plain ones, and plans
keep the properties that matter at scale."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankspark import catalog
from rankspark.functions import text
from rankspark.operators import groups, metrics, models, pairs, profile, retrieval, sampling, similarity, skew
from rankspark.session import new_path
from rankspark.sources import logs, tables


@pytest.fixture(scope="module")
def skewed(spark):
    """900 of 1500 rows share one key."""
    return spark.range(1500).select(
        F.col("id"), F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 40).alias("k"),
        (F.col("id") * 7919 % 101).alias("v"),
    )


def plain_positions(df):
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    return {r.id: r.p for r in df.withColumn("p", F.row_number().over(w)).collect()}


def test_group_positions(skewed):
    got = skew.group_positions(skewed, ["k"], [F.desc("v"), F.col("id")], "p")
    assert {r.id: r.p for r in got.collect()} == plain_positions(skewed)


def test_sorted_positions_cross_partitions(skewed):
    got = skew.sorted_positions(skewed, ["k"], [F.desc("v"), F.col("id")], "p")
    assert {r.id: r.p for r in got.collect()} == plain_positions(skewed)


def test_running_sums(skewed):
    got = {r.id: r.s for r in skew.running_sums(skewed, [F.col("v"), F.col("id")], {"s": "v"}).collect()}
    total, want = 0, {}
    for r in sorted(skewed.collect(), key=lambda r: (r.v, r.id)):
        total += r.v
        want[r.id] = total
    assert got == want


def test_gather_pages_hold_everything(skewed):
    pages = groups.gather(skewed, ["k"], [F.col("id")], F.col("id"), page_rows=100).where("k = 0").orderBy("page").collect()
    ids = [i for p in pages for i in p["items"]]
    assert max(len(p["items"]) for p in pages) <= 100
    assert ids == sorted(ids) and len(ids) == skewed.where("k = 0").count()


def test_runs(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aabbbacca")], "i int, c string")
    got = sorted((r.start, r.c, r.n) for r in groups.runs(rows, "c", [F.col("i")]).collect())
    assert got == [(1, "a", 2), (3, "b", 3), (6, "a", 1), (7, "c", 2), (9, "a", 1)]


def test_quantiles(spark):
    values = [3.0, 1.0, 1.0, 8.0, 5.0, 2.0]
    row = profile.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", (0.25, 0.5, 0.75)).first()
    assert tuple(row) == pytest.approx(tuple(np.percentile(values, [25, 50, 75])))


# ---------------------------------------------------------------- retrieval


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(260, 8))
    v[:120] = v[0] + 0.05 * v[:120]  # nearly half the corpus in one spot
    v[10] = v[11]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = lambda rows, name: spark.createDataFrame(
        [(int(i), int(i) % 3, v[i].tolist()) for i in rows], f"{name} bigint, city_id int, vector array<double>"
    )
    return v, frame(range(200), "item_id"), frame(range(200, 260), "query_id")


def brute(v, k, keep=lambda q, i: True):
    out = set()
    for q in range(200, 260):
        s = np.round(v[:200] @ v[q], 6)
        ids = [i for i in sorted(range(200), key=lambda i: (-s[i], i)) if keep(q, i)][:k]
        out |= {(q, i) for i in ids}
    return out


def found(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


def test_exact_top_k(cloud):
    v, items, queries = cloud
    assert found(retrieval.exact_top_k(queries, items, 7, n_cells=6)) == brute(v, 7)


def test_exact_top_k_beyond_corpus(cloud):
    v, items, queries = cloud
    assert found(retrieval.exact_top_k(queries, items.where("item_id < 5"), 9, n_cells=3)) == {
        (q, i) for q in range(200, 260) for i in range(5)
    }


def test_small_blocks(cloud):
    v, items, queries = cloud
    q = queries.select("query_id", F.col("city_id").alias("cell"), "vector")
    i = items.select("item_id", F.col("city_id").alias("cell"), "vector")
    got = found(retrieval.cell_top_k(q, i, 5, block_rows=7))
    assert got == brute(v, 5, lambda q, i: q % 3 == i % 3)


def test_probe_recall(cloud):
    v, items, queries = cloud
    exact, got = brute(v, 7), found(retrieval.probe_top_k(queries, items, 7, n_cells=6, n_probes=4))
    assert len(got & exact) / len(exact) > 0.8


def test_registered_probe_recall(spark, small):
    """knn_lsh as registered against knn_exact."""
    queries = catalog.load()[0]
    exact, got = (found(queries[name](spark, small)) for name in ("knn_exact", "knn_lsh"))
    assert len(got & exact) / len(exact) >= 0.9


def test_probes_fit_a_corpus_without_clusters(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = lambda rows, name: spark.createDataFrame([(i, v[i].tolist()) for i in rows], f"{name} bigint, vector array<double>")
    got = found(retrieval.probe_top_k(frame(range(800, 900), "query_id"), frame(range(800), "item_id"), 10))
    exact = {(q, int(i)) for q in range(800, 900) for i in np.argsort(-(v[:800] @ v[q]))[:10]}
    assert len(got & exact) / len(exact) >= 0.9


# ---------------------------------------------------------------- models and metrics


def test_logistic_learns_planted_signal(spark):
    rows = spark.range(2000).select("id", (F.col("id") * 37 % 101 / 101).alias("a"), (F.col("id") * 53 % 97 / 97).alias("b"))
    rows = models.training_rows(rows.withColumn("y", (F.col("a") > 0.5).cast("int")), "y", ["a", "b"])
    for penalty in ("l2", "l1"):
        model = models.logistic(rows, penalty)
        assert model.coefficients[0] > 5 * abs(model.coefficients[1])


def test_trees_and_leaves(spark):
    rows = spark.range(1200).select("id", (F.col("id") * 37 % 101 / 101).alias("a"), (F.col("id") * 53 % 97 / 97).alias("b"))
    rows = models.training_rows(rows.withColumn("y", ((F.col("a") > 0.5) != (F.col("b") > 0.5)).cast("int")), "y", ["a", "b"])
    model = models.boosted_trees(8, 3).fit(models.training_table(rows))
    scored = models.probability(model, rows)
    assert metrics.auc(scored, "label", "p").first().auc > 0.95
    leaves = [r.leaves for r in models.with_leaves(model, rows).select("leaves").distinct().collect()]
    spans = [(t.numNodes + 1) // 2 for t in model.trees]
    starts = np.cumsum([1] + spans[:-1])
    for row in leaves:
        assert all(s <= leaf < s + n for leaf, s, n in zip(row, starts, spans))


def test_pairwise_learns_order(spark):
    rows = spark.range(800).select(
        (F.col("id") / 4).cast("int").alias("g"), "id", F.array(F.col("id") * 37 % 101 / 101, F.col("id") * 53 % 97 / 97).alias("x")
    )
    best = Window.partitionBy("g").orderBy(F.desc(F.get("x", F.lit(0))))
    rows = rows.withColumn("y", F.row_number().over(best) == 1)
    both = pairs.positive_negative(rows, "g", [], ["x"], F.col("y"))
    model = models.pairwise_logistic(both, "pos_x", "neg_x", {"all": F.lit(True)})["all"]
    assert model.coefficients[0] > 3 * abs(model.coefficients[1])


def test_stacking_predicts_each_row_once(spark, small):
    t = profile.impute_mode(tables.tabular(spark, small), ["nation_cat", "bal"])
    rows = models.training_rows(t, "target", ["nation_cat", "bal"]).drop("label")
    make = {"gbt": lambda: models.boosted_trees(2, 2)}
    oof, ahead = models.stack(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), "id", "target", make, k=3)
    n = rows.where("id % 4 > 0").count()
    assert oof.count() == n == oof.select("id").distinct().count()
    assert ahead.count() == rows.count() - n
    assert metrics.auc(oof, "target", "gbt").first().auc > 0.7


def test_gini_is_twice_auc_minus_one(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.3)], "y int, p double")
    discordant = 2 + 0.5 - 1  # (0.3 < 0.8), the tie at 0.8 counts half
    assert metrics.gini(rows, "y", "p").first().gini == pytest.approx(1 - 2 * discordant / 6)


def test_sample_none_keeps_all(spark):
    df = spark.range(10)
    assert sampling.sample(df, F.col("id"), None) is df


def test_folds_are_even(spark):
    rows = spark.range(100).select("id", (F.col("id") < 30).cast("int").alias("y"))
    counts = sampling.stratified_folds(rows, "y", F.col("id"), 5).groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in counts} == {(1, 6), (0, 14)}


# ---------------------------------------------------------------- plans


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_log_scan_prunes_partitions(spark, small):
    path = new_path(spark, "log")
    logs.write_log(tables.search_log(spark, small), path)
    p = plan(logs.scan_log(spark, path, "1996-03-01", "1996-06-30", "ASIA"))
    filters = [line for line in p.splitlines() if "PartitionFilters" in line]
    assert filters and "dt" in filters[0] and "country_code" in filters[0]


def test_scan_reads_needed_columns_only(spark, small):
    p = plan(tables.impressions(spark, small).select("impression_id", "label"))
    assert "o_totalprice" not in p.split("ReadSchema", 1)[1] and "l_shipdate" not in p.split("ReadSchema", 1)[1]


@pytest.mark.parametrize("name", ["normalize_text", "parse_ltr_features", "densify_features", "geohash6", "char_trigrams", "token_ids"])
def test_scalar_work_stays_in_the_jvm(spark, small, name):
    import __spark_entry__ as entry

    p = plan(entry.queries()[name](spark, small))
    assert "Python" not in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_top_k_limits_before_the_shuffle(spark, small):
    im = tables.impressions(spark, small)
    assert "WindowGroupLimit" in plan(skew.top_k(im, ["uid"], [F.desc("score"), F.col("impression_id")], 3))


def test_control_characters(spark):
    rows = spark.createDataFrame([("a\x07b",), ("a\tb\n",), ("ok",)], "s string")
    assert [r.s for r in rows.where(~text.has_control_chars(F.col("s"))).collect()] == ["a\tb\n", "ok"]


# ---------------------------------------------------------------- texts


TEXTS = [
    (1, "The cat\nand the cat \U0001F600é万a and THE cat"), (2, "ab"), (3, ""), (4, None), (5, "İx \t  y"), (6, "abcabcab"),
    (7, "one two one"), (7, "two one two one"), (None, "one cat"), (None, "cat"), (8, "  the  cat "),
]


@pytest.fixture(scope="module")
def prose(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def by_id(split):
    """Counts of what ``split`` makes of the lower-cased texts, over all texts of an id."""
    out = {}
    for i, t in TEXTS:
        if t is not None:
            out.setdefault(i, collections.Counter()).update(split(t.lower()))
    return {i: c for i, c in out.items() if c}


def test_char_trigrams_of_ids_on_one_row_and_on_several(spark, prose, tmp_path):
    prose.select("*", F.lit("x").alias("lang"), F.lit("y").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    want = by_id(lambda t: [t[i : i + 3] for i in range(len(t) - 2)] if len(t) > 2 else [t] if t else [])
    got = {r.doc_id: tuple(r)[1:] for r in catalog.load()[0]["char_trigrams"](spark, str(tmp_path)).collect()}
    assert got == {i: (sum(c.values()), len(c), min(c), max(c)) for i, c in want.items()}


def test_term_counts_of_single_rows_are_not_exchanged(spark, prose):
    words = text.words_of(F.lower("text"))
    for terms, n in ((words, 1), (text.word_bigrams(words), 2)):
        def split(t):
            w = re.findall(r"[^ \t\n\x0b\f\r]+", t)
            return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]

        want = {(i, t): k for i, c in by_id(split).items() for t, k in c.items()}
        df = collections.Counter(t for _, t in want)
        got = similarity.tfidf(prose, "doc_id", terms).collect()
        assert {(r.doc_id, r.term): r.tf for r in got} == want and len(got) == len(want)
        assert all(r.weight == pytest.approx(r.tf * (math.log((len(TEXTS) + 1) / (df[r.term] + 1)) + 1)) for r in got)
        single = similarity.term_frequencies(prose.where("doc_id in (1, 2, 5, 6, 8)"), "doc_id", terms)
        assert "Exchange hashpartitioning" not in single._jdf.queryExecution().executedPlan().toString()


def test_char_trigrams_of_single_rows_are_not_exchanged(spark, prose, tmp_path):
    rows = prose.where("doc_id in (1, 2, 3, 4, 5, 6, 8)").coalesce(1)
    rows.select("*", F.lit("x").alias("lang"), F.lit("y").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.load()[0]["char_trigrams"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_similarities_are_computed_once_for_each_combination_of_texts(spark, monkeypatch):
    texts = [("blue cafe", "Blue cafe", "main st"), ("blue cafe", "blue bar", "main st"), ("red bar", "blue bar", "side st")]
    rows = spark.createDataFrame([(i, *texts[i % 3]) for i in range(30)], "id int, query string, name string, addr string")
    corpus = lambda c: rows.select(F.col(c).alias("text")).distinct()
    seen, real = [], similarity.attach_vectors
    monkeypatch.setattr(similarity, "attach_vectors", lambda df, *rest: seen.append(df.count()) or real(df, *rest))
    got = similarity.similarity_features(rows, corpus("query"), corpus("name"), corpus("addr")).collect()
    assert seen == [3, 3, 3] and sorted(r.id for r in got) == list(range(30))
    assert all(len(r.sim) == 23 and r.sim == got[0].sim for r in got if r.id % 3 == got[0].id % 3)


def test_rows_with_null_texts_keep_their_scores(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "b"), (4, None, None)], "id int, x string, y string")
    got = similarity.per_texts(rows, ["x", "y"], lambda t: t.withColumn("s", F.concat_ws("-", "x", "y"))).collect()
    assert sorted((r.id, r.s) for r in got) == [(1, "a"), (2, ""), (3, "a-b"), (4, "")]
