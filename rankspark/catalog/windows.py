"""Ranking, run and top-k checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.catalog.registry import check
from rankspark.functions import features
from rankspark.operators import groups, models, retrieval, skew
from rankspark.sources import tables

# Scores are whole hundredths here, so that ties are ties in both engines.
SQL_SCORE = "CAST(round(score * 100 + 0.001) AS BIGINT)"


def cents(c="score"):
    return F.round(F.col(c) * 100 + 0.001).cast("bigint")


@check("rank_in_group", "impressions", f"""
SELECT impression_id, row_number() OVER (PARTITION BY search_uid ORDER BY {SQL_SCORE} DESC, show_pos, impression_id) AS rank FROM impressions""")
def rank_in_group(spark, d):
    im = tables.impressions(spark, d).withColumn("score", cents()).select("search_uid", "score", "show_pos", "impression_id")
    order = [F.desc("score"), F.col("show_pos"), F.col("impression_id")]
    return skew.group_positions(im, ["search_uid"], order, "rank").select("impression_id", "rank")


@check("group_len", "impressions", "SELECT impression_id, count(*) OVER (PARTITION BY search_uid) AS group_len FROM impressions")
def group_len(spark, d):
    return groups.with_group_length(
        tables.impressions(spark, d).select("impression_id", "search_uid"), "search_uid"
    ).select("impression_id", "group_len")


@check("top3_pseudo_label", "impressions", """
SELECT impression_id, CASE WHEN label = 2 OR row_number() OVER (PARTITION BY search_uid ORDER BY show_pos, impression_id) <= 3 THEN 1 ELSE 0 END AS new_label FROM impressions""")
def top3_pseudo_label(spark, d):
    im = tables.impressions(spark, d).select("search_uid", "impression_id", "show_pos", "label")
    order = [F.col("show_pos"), F.col("impression_id")]
    marked = groups.mark_top(im, ["search_uid"], order, 3, "leading")
    return marked.select("impression_id", ((F.col("label") == 2) | F.col("leading")).cast("int").alias("new_label"))


@check("hard_negative_slice", "impressions", f"""
WITH r AS (SELECT uid, impression_id, row_number() OVER (PARTITION BY uid ORDER BY {SQL_SCORE} DESC, impression_id) - 1 AS rank FROM impressions)
SELECT uid, impression_id, rank, CASE WHEN rank BETWEEN 7 AND 12 THEN 0 ELSE 1 END AS part FROM r""")
def hard_negative_slice(spark, d):
    im = tables.impressions(spark, d).select("uid", "impression_id", cents().alias("score"))
    ranked = skew.group_positions(im, ["uid"], [F.desc("score"), F.col("impression_id")], "rank")
    rank = (F.col("rank") - 1).alias("rank")
    return ranked.select("uid", "impression_id", rank, retrieval.slice_part(F.col("rank") - 1).alias("part"))


@check("run_groups", "", """
WITH o AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS change FROM o),
g AS (SELECT *, sum(change) OVER (ORDER BY pos) AS run FROM f)
SELECT event_type, min(pos) AS start, count(*) AS n FROM g GROUP BY event_type, run""")
def run_groups(spark, d):
    events = tables.table(spark, d, "events").select("event_type", "ts", "event_id")
    return groups.runs(events, "event_type", [F.col("ts"), F.col("event_id")])


@check("sort_show_pos", "impressions", f"""
WITH r AS (SELECT *, (row_number() OVER (PARTITION BY search_uid ORDER BY show_pos, impression_id) - 1) // {tables.LOG_PAGE_ITEMS} AS page FROM impressions)
SELECT search_uid, page, string_agg(impression_id, ',' ORDER BY show_pos, impression_id) AS items FROM r GROUP BY search_uid, page""")
def sort_show_pos(spark, d):
    from rankspark.operators import records

    parsed = records.parse_log(tables.search_log(spark, d))
    shuffled = parsed.withColumn("items", F.reverse("items"))
    items = records.by_show_position(F.col("items"))
    return shuffled.select("search_uid", "page", F.array_join(F.transform(items, lambda p: p.p_impression_id), ",").alias("items"))


@check("topk_per_query", "impressions", f"""
WITH r AS (SELECT uid, impression_id, row_number() OVER (PARTITION BY uid ORDER BY {SQL_SCORE} DESC, impression_id) AS rank FROM impressions)
SELECT * FROM r WHERE rank <= 10""")
def topk_per_query(spark, d):
    im = tables.impressions(spark, d).select("uid", "impression_id", cents().alias("score"))
    return skew.top_k(im, ["uid"], [F.desc("score"), F.col("impression_id")], 10).drop("score")


@check("batch_score", "impressions", """
SELECT impression_id, round(1 / (1 + exp(-(0.02 * f1 - 0.00001 * f2 + f3 - f4))), 6) AS score FROM impressions""")
def batch_score(spark, d):
    f = features.parse_features(F.col("ltr_features"))
    rows = tables.impressions(spark, d).select(
        "impression_id", F.slice(features.densify(f, F.lit(0), 4), 2, 4).alias("x")
    )
    scored = models.score_batches(rows, "x", models.LinearScorer([0.02, -0.00001, 1.0, -1.0], 0.0), "score")
    return scored.select("impression_id", F.round("score", 6).alias("score"))
