"""Evaluation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.catalog.models import pair_tasks
from rankspark.catalog.registry import check
from rankspark.catalog.windows import SQL_SCORE, cents
from rankspark.functions import features
from rankspark.operators import metrics, pairs, records
from rankspark.session import materialise
from rankspark.sources import tables


@check("topk_hit_rate", "impressions", f"""
WITH s AS (SELECT search_uid, country_code, CASE WHEN query_type = 4 THEN 'start' ELSE 'end' END AS side, label - 1 AS click,
  row_number() OVER (PARTITION BY search_uid ORDER BY {SQL_SCORE} DESC, show_pos, impression_id) AS rank FROM impressions WHERE label >= 1),
g AS (SELECT search_uid, country_code, side, sum(click) FILTER (rank <= 1) AS h1, sum(click) FILTER (rank <= 3) AS h3,
  sum(click) FILTER (rank <= 5) AS h5 FROM s GROUP BY ALL),
a AS (SELECT * FROM g UNION ALL SELECT search_uid, country_code, 'total', h1, h3, h5 FROM g)
SELECT country_code, side, count(*) AS n_groups, round(avg(h1), 6) AS hit_rate_1, round(avg(h3), 6) AS hit_rate_3, round(avg(h5), 6) AS hit_rate_5,
  round(avg((h1 > 0)::INT), 6) AS hit_any_1, round(avg((h3 > 0)::INT), 6) AS hit_any_3, round(avg((h5 > 0)::INT), 6) AS hit_any_5 FROM a GROUP BY ALL""")
def topk_hit_rate(spark, d):
    """From the JSON log to hit rates per region and side, with both sides together."""
    f = lambda i: F.try_element_at("features", F.lit(i))
    rows = records.samples(tables.search_log(spark, d)).select(
        "search_uid", "country_code", "label", F.col("p_show_pos").alias("show_pos"),
        F.col("p_impression_id").alias("impression_id"),
        F.when(F.col("g_query_type") == "4", "start").otherwise("end").alias("side"),
        (f(2) * (1 - f(3)) / f(1)).alias("score"),
    ).withColumn("score", cents())
    order = [F.desc("score"), F.col("show_pos"), F.col("impression_id")]
    per_side = metrics.hit_rates(rows, "search_uid", ["country_code", "side"], F.col("label") - 1, order)
    # Both sides together are the group-weighted mean of the two, as a search has one side.
    names = [f"hit_{kind}_{k}" for kind in ("rate", "any") for k in (1, 3, 5)]
    both = per_side.select(F.inline(F.array(*[
        F.struct("country_code", s.alias("side"), "n_groups", *names) for s in (F.col("side"), F.lit("total"))
    ])))
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("n_groups")) / F.sum("n_groups"), 6).alias(c)
    return both.groupBy("country_code", "side").agg(F.sum("n_groups").alias("n_groups"), *[weighted(c) for c in names])


@check("ndcg3", "impressions", f"""
WITH r AS (SELECT search_uid, [1.0, 1.0, 3.0][label + 1]::DOUBLE AS gain,
  row_number() OVER (PARTITION BY search_uid ORDER BY {SQL_SCORE} DESC, show_pos, impression_id) AS pr,
  row_number() OVER (PARTITION BY search_uid ORDER BY label DESC) AS ir FROM impressions)
SELECT search_uid, round(sum(gain / log2(pr + 1)) FILTER (pr <= 3) / sum(gain / log2(ir + 1)) FILTER (ir <= 3), 6) AS ndcg FROM r GROUP BY search_uid""")
def ndcg3(spark, d):
    im = tables.impressions(spark, d).withColumn("score", cents())
    order = [F.desc("score"), F.col("show_pos"), F.col("impression_id")]
    return metrics.ndcg(im, "search_uid", "label", order).withColumn("ndcg", F.round("ndcg", 6))


# A click counts as predicted when its value is above 40.
@check("classification_report", "clicks", """
WITH p AS (SELECT isclk AS l, CASE WHEN dclk > 40 THEN 1 ELSE 0 END AS p FROM clicks),
c AS (SELECT k AS class, count(*) FILTER (l = k AND p = k) AS tp, count(*) FILTER (p = k) AS g, count(*) FILTER (l = k) AS s
  FROM p, (SELECT unnest([0, 1]) AS k) GROUP BY k)
SELECT class, round(tp / g, 6) AS precision, round(tp / s, 6) AS recall, round(2 * (tp / g) * (tp / s) / (tp / g + tp / s), 6) AS f1, s AS support FROM c""")
def classification_report(spark, d):
    rows = tables.clicks(spark, d).withColumn("p", F.when(F.col("dclk") > 40, 1).otherwise(0))
    report = metrics.classification_report(rows, "isclk", "p")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


SQL_COUNTS = """
s AS (SELECT dclk AS threshold, sum(isclk) AS pos, count(*) - sum(isclk) AS neg FROM clicks GROUP BY dclk),
c AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY threshold DESC)),
t AS (SELECT sum(isclk) AS p, count(*) - sum(isclk) AS n FROM clicks)"""


@check("pr_curve", "clicks", f"""
WITH {SQL_COUNTS} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / t.p, 6) AS recall FROM c, t""")
def pr_curve(spark, d):
    curve = metrics.pr_curve(tables.clicks(spark, d), "isclk", "dclk")
    return curve.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@check("roc_auc", "clicks", f"""
WITH {SQL_COUNTS} SELECT threshold, round(fp / t.n, 6) AS fpr, round(tp / t.p, 6) AS tpr FROM c, t
UNION ALL SELECT NULL, NULL, round(sum(neg * (2 * tp - pos) / 2) / (any_value(t.p) * any_value(t.n)), 6) FROM c, t""")
def roc_auc(spark, d):
    # The last row holds the area in place of a rate.
    rows = tables.clicks(spark, d)
    area = metrics.auc(rows, "isclk", "dclk").select(
        F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("fpr"), F.col("auc").alias("tpr")
    )
    both = metrics.roc_curve(rows, "isclk", "dclk").unionByName(area)
    return both.withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


SQL_GINI = f"WITH {SQL_COUNTS} SELECT round(2 * sum(neg * (2 * tp - pos) / 2) / (any_value(t.p) * any_value(t.n)) - 1, 6) AS gini FROM c, t"


@check("gini", "clicks", SQL_GINI)
def gini(spark, d):
    return metrics.gini(tables.clicks(spark, d), "isclk", "dclk").select(F.round("gini", 6).alias("gini"))


@check("gini_normalized", "clicks", SQL_GINI)
def gini_normalized(spark, d):
    return metrics.gini_normalised(tables.clicks(spark, d), "isclk", "dclk").select(F.round("gini", 6).alias("gini"))


@check("pairwise_loss", "order_log", """
WITH o AS (SELECT search_uid, impression_id, label FROM order_log),
t AS (SELECT i.search_uid, i.search_id, i.f3, 'order' AS data_type, o.label FROM o JOIN impressions i USING (impression_id)
  UNION ALL SELECT search_uid, search_id, f3, 'click', label FROM impressions WHERE search_uid NOT IN (SELECT search_uid FROM o)),
p AS (SELECT p.search_id % 2 = 0 AS start, p.data_type, ln(1 + exp(sqrt(n.f3) - sqrt(p.f3))) AS loss
  FROM t p JOIN t n USING (search_uid) WHERE p.label = 2 AND n.label <> 2)
SELECT round(avg(CASE WHEN start AND data_type = 'click' THEN loss ELSE 0 END), 6) AS start_click_loss,
  round(avg(CASE WHEN start AND data_type = 'order' THEN loss ELSE 0 END), 6) AS start_order_loss,
  round(avg(CASE WHEN NOT start AND data_type = 'click' THEN loss ELSE 0 END), 6) AS end_click_loss,
  round(avg(CASE WHEN NOT start AND data_type = 'order' THEN loss ELSE 0 END), 6) AS end_order_loss FROM p""")
def pairwise_loss(spark, d):
    third = F.try_element_at(features.parse_features(F.col("ltr_features")), F.lit(3))
    columns = ["search_uid", "search_id", "s", "data_type", "label"]
    im = tables.impressions(spark, d).withColumns({"s": F.sqrt(third), "as_order": tables.order_label()}).select("search_uid", "search_id", "query_type", "s", "label", "as_order")
    im = materialise(im, "ranking")
    order = im.where("query_type = 4").select("search_uid", "search_id", "s", F.lit("order").alias("data_type"), F.col("as_order").alias("label"))
    taken = materialise(pairs.prefer_orders(im.withColumn("data_type", F.lit("click")).select(*columns), order, "search_uid"), "taken")
    both = pairs.positive_negative(taken, "search_uid", ["search_id", "data_type"], ["s"], F.col("label") == 2)
    masks = {f"{task}_loss": condition for task, condition in pair_tasks().items()}
    loss = metrics.pairwise_loss(both, F.col("pos_s"), F.col("neg_s"), masks)
    return loss.select(*[F.round(c, 6).alias(c) for c in loss.columns])
