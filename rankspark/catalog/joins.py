"""Join, pairing and lookup checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.catalog.registry import check
from rankspark.functions import text
from rankspark.operators import dictionary, pairs, retrieval, skew
from rankspark.session import new_path
from rankspark.sources import logs, tables


def item_index(places):
    """Items numbered 0..n-1 by id."""
    placed = skew.sorted_positions(places.select("poi_id"), [], [F.col("poi_id")], "idx")
    return placed.withColumn("idx", F.col("idx") - 1)


@check("join_item_index", "impressions places", """
WITH idx AS (SELECT poi_id, row_number() OVER (ORDER BY poi_id) - 1 AS idx FROM places)
SELECT impression_id, CASE WHEN i.layer <= 40 THEN idx END AS idx, CASE WHEN i.layer <= 40 THEN idx ELSE 0 END AS idx_or_zero
FROM impressions i JOIN idx USING (poi_id)""")
def join_item_index(spark, d):
    # Impressions of the top layers ask for an item that no index has.
    idx = item_index(tables.places(spark, d))
    asked = F.when(F.col("layer") > 40, -F.col("poi_id") - 1).otherwise(F.col("poi_id")).alias("poi_id")
    joined = tables.impressions(spark, d).select("impression_id", asked).join(idx, "poi_id", "left")
    return joined.select("impression_id", "idx", F.coalesce("idx", F.lit(0)).alias("idx_or_zero"))


SQL_TAKEN = """
taken AS (SELECT search_uid, impression_id, data_type, label FROM order_log
  UNION ALL SELECT search_uid, impression_id, 'click', label FROM impressions
  WHERE search_uid NOT IN (SELECT search_uid FROM order_log))"""


@check("prefer_order_over_click", "order_log", f"WITH {SQL_TAKEN} SELECT * FROM taken")
def prefer_order_over_click(spark, d):
    columns = ["search_uid", "impression_id", "data_type", "label"]
    click = tables.impressions(spark, d).withColumn("data_type", F.lit("click")).select(*columns)
    return pairs.prefer_orders(click, tables.order_log(spark, d).select(*columns), "search_uid")


@check("encode_ids", "searchers impressions", """
WITH c AS (SELECT category AS value, count(*) AS cnt FROM impressions GROUP BY category HAVING count(*) > 2400),
cat AS (SELECT value, row_number() OVER (ORDER BY cnt DESC, value) AS idx FROM (
  SELECT * FROM c UNION ALL SELECT 'UNK', (SELECT count(*) FROM impressions)))
SELECT impression_id, CAST(coalesce(cat.idx, (SELECT idx FROM cat WHERE value = 'UNK')) AS INT) AS cate_id,
  CAST(right(uid_text, 8) AS BIGINT) % 14138257 AS uid_id
FROM impressions JOIN searchers USING (uid) LEFT JOIN cat ON cat.value = category""")
def encode_ids(spark, d):
    im = tables.impressions(spark, d).select("impression_id", "uid", "category")
    users = tables.searchers(spark, d).select("uid", "uid_text")
    counts = dictionary.value_counts(im, {"cate": [F.col("category")]})
    counts = dictionary.filter_by_count(counts, {"cate": 2400}).unionByName(dictionary.unknown_rows(im, ["cate"]))
    out = dictionary.look_up(
        im.join(users, "uid"), dictionary.number(counts),
        {"cate_id": ("category", "cate"), "uid_id": ("uid_text", "uid")},
    )
    return out.select("impression_id", "cate_id", "uid_id")


@check("semi_join_corpus", "vectors", """
SELECT q.vec_id FROM vectors q WHERE q.doctype = 'query' AND q.vec_id + 7 IN (SELECT vec_id FROM vectors WHERE doctype = 'doc' AND city_id < 7)""")
def semi_join_corpus(spark, d):
    v = tables.vectors(spark, d)
    queries = v.where("doctype = 'query'").select("vec_id", (F.col("vec_id") + 7).alias("poi_id"))
    corpus = v.where("doctype = 'doc' AND city_id < 7").select(F.col("vec_id").alias("poi_id"))
    return queries.join(corpus, "poi_id", "left_semi").select("vec_id")


@check("pairs_pos_neg", "impressions", """
SELECT p.search_uid, p.uid, p.impression_id AS pos_impression_id, n.impression_id AS neg_impression_id,
  p.poi_id AS pos_poi_id, n.poi_id AS neg_poi_id
FROM impressions p JOIN impressions n ON p.search_uid = n.search_uid WHERE p.label = 2 AND n.label <> 2""")
def pairs_pos_neg(spark, d):
    return pairs.positive_negative(
        tables.impressions(spark, d), "search_uid", ["uid"], ["impression_id", "poi_id"], F.col("label") == 2
    )


SQL_LAST = """
last AS (SELECT search_uid, max_by(name_address, (show_pos, impression_id)) AS pos_name, max_by(impression_id, (show_pos, impression_id)) AS pos_id
  FROM impressions WHERE label = 2 GROUP BY search_uid)"""


@check("pairs_query_text", "impressions", f"""
WITH {SQL_LAST}
SELECT impression_id, query || '|' || pos_name AS pos_text, query || '|' || name_address AS neg_text
FROM impressions JOIN last USING (search_uid) WHERE label <> 2""")
def pairs_query_text(spark, d):
    p = pairs.clicked_against_rest(tables.impressions(spark, d), "search_uid", ["name_address"])
    return p.select(
        "impression_id", F.concat_ws("|", "query", "pos_name_address").alias("pos_text"),
        F.concat_ws("|", "query", "name_address").alias("neg_text"),
    )


@check("pair_top_with_all", "impressions", """
WITH top AS (SELECT search_uid, arg_min(impression_id, (-label, show_pos, impression_id)) AS pos_impression_id,
  max(label) AS best FROM impressions GROUP BY search_uid)
SELECT impression_id, pos_impression_id, best = 2 AS has_positive FROM impressions JOIN top USING (search_uid)""")
def pair_top_with_all(spark, d):
    p = pairs.top_with_all(tables.impressions(spark, d), "search_uid", ["impression_id", "label"])
    return p.select("impression_id", "pos_impression_id", (F.col("pos_label") == 2).alias("has_positive"))


@check("pairs_hard_easy", "impressions", f"""
WITH {SQL_LAST}
SELECT impression_id, pos_id AS pos_impression_id,
  CASE WHEN impression_id = pos_id THEN 1 WHEN label = 0 THEN 2 ELSE 0 END AS part
FROM impressions JOIN last USING (search_uid) WHERE label <> 2 OR impression_id = pos_id""")
def pairs_hard_easy(spark, d):
    im = tables.impressions(spark, d)
    listed = im.withColumn("show_pos", F.when(F.col("label") == 0, -1).otherwise(F.col("show_pos")))
    return pairs.clicked_hard_easy(listed, "search_uid", []).select("impression_id", "pos_impression_id", "part")


@check("self_pairs", "impressions", """
SELECT search_uid, uid, impression_id AS pos_impression_id, label AS pos_label,
  impression_id AS neg_impression_id, label AS neg_label FROM impressions""")
def self_pairs(spark, d):
    return pairs.self_pairs(tables.impressions(spark, d), "search_uid", ["uid"], ["impression_id", "label"])


@check("join_predictions", "impressions", """
SELECT search_uid, impression_id, label, round(sqrt(score), 6) AS pred FROM impressions""")
def join_predictions(spark, d):
    # Labels and scores are stored apart and meet again by row key, never by position.
    im = tables.impressions(spark, d)
    labels_path, scores_path = new_path(spark, "labels"), new_path(spark, "scores")
    im.select("impression_id", "search_uid", "label").write.parquet(labels_path)
    im.select("impression_id", F.round(F.sqrt("score"), 6).alias("pred")).write.parquet(scores_path)
    return spark.read.parquet(labels_path).join(spark.read.parquet(scores_path), "impression_id")


@check("union_countries", "impressions", """
SELECT country_code, count(DISTINCT search_uid) AS n FROM impressions
WHERE country_code IN ('ASIA', 'EUROPE', 'AFRICA') AND date_trunc('month', dt) BETWEEN DATE '1992-01-01' AND DATE '1998-12-01' GROUP BY country_code""")
def union_countries(spark, d):
    path = new_path(spark, "log")
    logs.write_log(tables.search_log(spark, d), path)
    log = logs.union_countries(spark, path, "1992-01-01", "1998-12-01", ["ASIA", "EUROPE", "AFRICA"])
    return log.where("page = 0").groupBy("country_code").agg(F.count(F.lit(1)).alias("n"))


@check("city_fallback_join", "searchers places", """
WITH c AS (SELECT city_id, count(*) AS n_items, min(poi_id) AS first_item FROM places GROUP BY city_id)
SELECT uid, coalesce(c.city_id, 7) AS search_city, f.n_items, f.first_item FROM searchers s
LEFT JOIN c ON c.city_id = s.city_id AND s.city_id >= 5 JOIN c f ON f.city_id = coalesce(c.city_id, 7)""")
def city_fallback_join(spark, d):
    # Searchers of the first five cities ask in one that has no items.
    items = tables.places(spark, d)
    summary = items.groupBy("city_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("poi_id").alias("first_item"))
    city = F.when(F.col("city_id") < 5, -1).otherwise(F.col("city_id"))
    routed = retrieval.route_to_city(tables.searchers(spark, d).withColumn("city_id", city), items, default_city=7)
    return skew.attach(
        routed.select("uid", "search_city"), summary.withColumnRenamed("city_id", "search_city"), ["search_city"]
    )


@check("exclude_clicked", "impressions", """
SELECT impression_id FROM impressions i WHERE NOT EXISTS (SELECT 1 FROM impressions c
  WHERE c.label = 2 AND c.search_uid = i.search_uid AND c.poi_id = i.poi_id)""")
def exclude_clicked(spark, d):
    im = tables.impressions(spark, d).select("search_uid", "poi_id", "impression_id", "label")
    clicked = im.where("label = 2").select("search_uid", "poi_id")
    return retrieval.exclude(im, clicked, ["search_uid", "poi_id"]).select("impression_id")


@check("join_two_roles", "impressions places", f"""
WITH {SQL_LAST}, c AS (SELECT i.impression_id, i.poi_id AS neg, l.poi_id AS pos
  FROM impressions i JOIN last USING (search_uid) JOIN impressions l ON l.impression_id = last.pos_id WHERE i.label <> 2)
SELECT impression_id, p.lat AS pos_lat, p.lng AS pos_lng, n.lat AS neg_lat, n.lng AS neg_lng
FROM c JOIN places p ON p.poi_id = c.pos JOIN places n ON n.poi_id = c.neg""")
def join_two_roles(spark, d):
    items = tables.places(spark, d)
    rows = pairs.clicked_against_rest(tables.impressions(spark, d), "search_uid", ["poi_id"]).select(
        "impression_id", "pos_poi_id", F.col("poi_id").alias("neg_poi_id")
    )
    for role in ("pos", "neg"):
        rows = rows.join(items.select(
            F.col("poi_id").alias(f"{role}_poi_id"), F.col("lat").alias(f"{role}_lat"), F.col("lng").alias(f"{role}_lng")
        ), f"{role}_poi_id")
    return rows.select("impression_id", "pos_lat", "pos_lng", "neg_lat", "neg_lng")


@check("append_features", "impressions", """
SELECT impression_id, f1, f4 AS f4_kept, CASE WHEN label = 2 THEN show_pos END AS f5 FROM impressions""")
def append_features(spark, d):
    # New features join by row key; an index already present keeps its value.
    from rankspark.functions import features

    im = tables.impressions(spark, d).withColumn("f", features.parse_features(F.col("ltr_features")))
    extra = im.where("label = 2").select(
        "impression_id", F.create_map(F.lit(4), F.lit(-1.0), F.lit(5), F.col("show_pos").cast("double")).alias("extra")
    )
    both = features.append(im, extra, "impression_id", "f", "extra")
    return both.select(
        "impression_id", F.try_element_at("f", F.lit(1)).alias("f1"), F.try_element_at("f", F.lit(4)).alias("f4_kept"),
        F.try_element_at("f", F.lit(5)).cast("int").alias("f5"),
    )
