"""Model checks. Fits are not expressible in SQL, so most give rows only; every one trains
on whole tables, with few iterations."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rankspark.catalog.registry import check, ints
from rankspark.functions import features
from rankspark.operators import models, pairs, profile, sampling
from rankspark.session import materialise
from rankspark.sources import tables


def click_rows(spark, d):
    """Click table with log-scaled value and the hour as features."""
    c = tables.clicks(spark, d)
    return models.training_rows(c, "isclk", [F.log1p("dclk"), F.col("hr") / 24])


def ranking_rows(spark, d, keep=(), label=None):
    """Impressions with their four ranking features; clicked or not is the label."""
    f = features.parse_features(F.col("ltr_features"))
    dense = F.array(*[features.slot_of(F.col("f"), F.lit(0), i) for i in range(1, 5)])
    extra = [] if label is None else [label.alias("as_order")]
    return tables.impressions(spark, d).withColumn("f", f).select(
        "search_uid", "impression_id", "query_type", "show_pos", (F.col("label") == 2).cast("double").alias("label"),
        dense.alias("x"), *[c for c in keep if c != "query_type"], *extra,
    ).withColumn("features", array_to_vector("x"))


def _fitted(spark, d, penalty):
    rows = click_rows(spark, d)
    model = models.logistic(rows, penalty, max_iter=20)
    return models.probability(model, rows).select(
        "cid", "isclk", F.round("p", 6).alias("p"), (F.col("p") > 0.5).cast("int").alias("predicted")
    )


@check("lr_l2")
def lr_l2(spark, d):
    return _fitted(spark, d, "l2")


@check("lr_l1")
def lr_l1(spark, d):
    return _fitted(spark, d, "l1")


@check("weight_histogram")
def weight_histogram(spark, d):
    model = models.logistic(click_rows(spark, d), "l2", max_iter=20)
    return profile.histogram(models.coefficients(model, ["log_dclk", "hour"]), "weight")


def _trees(rows, trees=5, depth=3):
    split = rows.withColumns({
        "is_validation": sampling.unit_hash(F.col("impression_id"), 1) < 0.2,
        "weight": F.when(F.col("label") == 1, models.POSITIVE_WEIGHT).otherwise(1.0),
    })
    # Patience in proportion to the few trees of these trials.
    return models.boosted_with_patience(split, patience=max(1, trees // 2), trees=trees, depth=depth, weight="weight")[0]


@check("gbt_train")
def gbt_train(spark, d):
    rows = ranking_rows(spark, d)
    return models.probability(_trees(rows), rows).select("impression_id", "label", F.round("p", 6).alias("p"))


@check("gbt_leaves")
def gbt_leaves(spark, d):
    rows = ranking_rows(spark, d)
    return models.with_leaves(_trees(rows), rows).select(
        "impression_id", ints("leaves").alias("leaves"), F.round("tree_score", 6).alias("tree_score")
    )


# Both sides of a search and both logs: four tasks.
def pair_tasks():
    start, click = F.pmod("search_id", F.lit(2)) == 0, F.col("data_type") == "click"
    return {"start_click": start & click, "start_order": start & ~click, "end_click": ~start & click, "end_order": ~start & ~click}


@check("pairwise_lr")
def pairwise_lr(spark, d):
    rows = materialise(ranking_rows(spark, d, ["search_id", "query_type"], label=tables.order_label()).drop("features", "impression_id", "show_pos"), "ranking")
    order = rows.where("query_type = 4").withColumn("data_type", F.lit("order"))
    taken = materialise(pairs.prefer_orders(rows.withColumn("data_type", F.lit("click")), order, "search_uid"), "taken")
    clicked = F.when(F.col("data_type") == "order", F.col("as_order") == 2).otherwise(F.col("label") == 1)
    both = pairs.positive_negative(taken, "search_uid", ["search_id", "data_type"], ["x"], clicked)
    fitted = models.pairwise_tasks(both, "pos_x", "neg_x", pair_tasks())
    found = [(t, f"f{i + 1}", float(w)) for t in fitted.tasks for i, w in enumerate(fitted.weights(t))]
    return spark.createDataFrame(found, "task string, feature string, weight double").withColumn("weight", F.round("weight", 4))


SQL_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@check("dummies", "tabular", f"""
SELECT id, {', '.join(f"CASE WHEN seg_cat = '{v}' THEN 1 ELSE 0 END AS seg_cat_{v}" for v in SQL_LEVELS)} FROM tabular""")
def dummies(spark, d):
    # Levels come from the rows with a target of 1; all segments occur there.
    t = tables.tabular(spark, d)
    wide = profile.dummies(t.where("target = 1"), t, ["seg_cat"])
    return wide.select("id", *[c for c in wide.columns if c.startswith("seg_cat_")])


# Levels of the rows with a target of 1; the id is a column of as many levels as there are such rows.
HOT = ["seg_cat", "nation_cat", "id"]


@check("dummies_sparse", "tabular", f"""
WITH lv AS (SELECT DISTINCT col, v FROM (SELECT unnest([1, 2, 3]) AS col, unnest([{', '.join(f"CAST({c} AS STRING)" for c in HOT)}]) AS v FROM tabular WHERE target = 1) WHERE v IS NOT NULL),
ix AS (SELECT col, v, row_number() OVER (ORDER BY col, v) - 1 AS idx FROM lv),
r AS (SELECT id, unnest([1, 2, 3]) AS col, unnest([{', '.join(f"CAST({c} AS STRING)" for c in HOT)}]) AS v FROM tabular)
SELECT id, CAST(idx AS INT) AS level FROM r JOIN ix USING (col, v)""")
def dummies_sparse(spark, d):
    t = tables.tabular(spark, d)
    index = profile.level_index(t.where("target = 1"), HOT)
    return profile.one_hot(t, index, HOT).select("id", F.explode("hot").alias("level"))


@check("oof_stacking")
def oof_stacking(spark, d):
    t = profile.impute_mode(tables.tabular(spark, d), ["nation_cat", "bal"])
    rows = models.training_rows(t, "target", ["nation_cat", "bal", "ps_calc_01"]).drop("label")
    part = sampling.train_test(F.col("id"))
    estimators = {
        "lr": lambda: LogisticRegression(maxIter=10),
        "gbt": lambda: models.boosted_trees(3, 3),
    }
    oof, test = models.stack(
        rows.where(part == "train"), rows.where(part == "test"), "id", "target", estimators, k=5
    )
    shown = lambda df, kind: df.select(
        "id", F.lit(kind).alias("part"), F.round("lr", 6).alias("lr"), F.round("gbt", 6).alias("gbt")
    )
    return shown(oof, "train").unionByName(shown(test, "test"))


@check("fm_train")
def fm_train(spark, d):
    # One-hot ids of city, layer and query type, as sparse vectors.
    names = ["city_id", "layer", "query_type"]
    im = tables.impressions(spark, d).select("impression_id", (F.col("label") == 2).cast("double").alias("label"), *names)
    hot = [f"{n}_hot" for n in names]
    rows = OneHotEncoder(inputCols=names, outputCols=hot, dropLast=False).fit(im).transform(im)
    rows = VectorAssembler(inputCols=hot, outputCol="features").transform(rows).select("impression_id", "label", "features")
    model = models.factorisation(4, max_iter=5).fit(models.training_table(rows))
    return models.probability(model, rows).select("impression_id", F.round("p", 6).alias("p"))
