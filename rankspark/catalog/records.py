"""Record parsing, projection and filter checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rankspark import fields
from rankspark.catalog.registry import check, ints, scaled
from rankspark.catalog.texts import sql_normalise
from rankspark.functions import features, geo, text
from rankspark.operators import records
from rankspark.session import new_path
from rankspark.sources import files, tables

SQL_NAME = f"{sql_normalise('split_part(name_address, chr(124), 1)')} || '|' || {sql_normalise('split_part(name_address, chr(124), 2)')}"


def _parsed(spark, d):
    return records.parse_log(tables.search_log(spark, d))


@check("project_query_fields", "impressions", f"""
SELECT search_uid, {sql_normalise('min(query)')} AS g_disp_query, CAST(min(city_id) AS STRING) AS g_disp_area,
  CAST(min(uid) AS STRING) AS g_uid, NULL::DOUBLE AS g_plng, NULL::DOUBLE AS g_plat, min(time_text) AS g_timestamp,
  CAST(min(query_type) AS STRING) AS g_query_type, '[UNK]' AS q_geohash, '' AS component_terms, '' AS component_ids
FROM impressions GROUP BY search_uid""")
def project_query_fields(spark, d):
    return records.query_rows(_parsed(spark, d).where("page = 0"))


@check("explode_items", "impressions", f"""
SELECT search_uid, CAST(uid AS STRING) AS g_uid, impression_id AS p_impression_id, CAST(poi_id AS STRING) AS p_poi_id,
  {SQL_NAME} AS p_name_address, show_pos AS p_show_pos, CAST(layer AS STRING) AS p_layer, category AS p_category FROM impressions""")
def explode_items(spark, d):
    return records.item_rows(_parsed(spark, d)).select(
        "search_uid", "g_uid", "p_impression_id", "p_poi_id", "p_name_address", "p_show_pos", "p_layer", "p_category"
    )


@check("filter_label", "impressions", """
SELECT search_uid, count(*) FILTER (label >= 1) AS n_shown, count(*) AS n_recalled FROM impressions GROUP BY search_uid""")
def filter_label(spark, d):
    return _parsed(spark, d).groupBy("search_uid").agg(
        F.sum(F.size(records.keep_labelled(F.col("items"), 1))).alias("n_shown"),
        F.sum(F.size(records.keep_labelled(F.col("items"), 0))).alias("n_recalled"),
    )


@check("drop_incomplete_groups", "impressions", """
SELECT search_uid, impression_id FROM impressions i
WHERE NOT EXISTS (SELECT 1 FROM impressions x WHERE x.search_uid = i.search_uid AND x.layer > 45)""")
def drop_incomplete_groups(spark, d):
    # Items of the top layers lose their features, which removes their whole search.
    lost = F.transform("items", lambda p: p.withField(
        "p_ltrfeatures", F.when(p.p_layer.cast("int") > 45, "null").otherwise(p.p_ltrfeatures)
    ))
    kept = records.drop_incomplete(_parsed(spark, d).withColumn("items", lost))
    return kept.select("search_uid", F.explode("items.p_impression_id").alias("impression_id"))


@check("parse_ltr_features", "impressions", """
SELECT impression_id, 'indexed' AS form, f1, f2, f3, f4 FROM impressions
UNION ALL SELECT impression_id, 'plain', f4, f3, f2, f1 FROM impressions""")
def parse_ltr_features(spark, d):
    im = tables.impressions(spark, d)
    cells = F.transform(F.split("ltr_features", ";"), lambda t: F.get(F.split(t, ":"), 1))
    plain = im.withColumn("ltr_features", F.concat(F.array_join(F.reverse(cells), ";"), F.lit(";")))
    both = im.withColumn("form", F.lit("indexed")).unionByName(plain.withColumn("form", F.lit("plain")))
    parsed = both.select("impression_id", "form", features.parse_features(F.col("ltr_features")).alias("f"))
    return parsed.select(
        "impression_id", "form", *[F.try_element_at("f", F.lit(i)).alias(f"f{i}") for i in range(1, 5)]
    )


@check("filter_min_fields", "impressions", """
SELECT impression_id FROM impressions WHERE layer > 10""")
def filter_min_fields(spark, d):
    # Lower layers write a shorter line.
    line = F.when(F.col("layer") > 10, F.concat_ws("\t", "impression_id", "uid", "label", "show_pos")).otherwise(
        F.concat_ws("\t", "impression_id", "uid")
    )
    lines = tables.impressions(spark, d).select(line.alias("value"))
    return records.min_fields(lines, 4).select(F.get(F.split("value", "\t"), 0).alias("impression_id"))


@check("malformed_tokens", "impressions", """
SELECT impression_id, '3' AS tokens FROM impressions WHERE f3 >= 0.05""")
def malformed_tokens(spark, d):
    im = tables.impressions(spark, d)
    damaged = F.regexp_replace("ltr_features", r";3:0\.(05|06|07|08|09|1)(;|$)", ";3$2")
    bad = im.select("impression_id", features.malformed_tokens(damaged).alias("bad"))
    return bad.where(F.size("bad") > 0).select("impression_id", ints("bad").alias("tokens"))


@check("filter_city_origin_len", "impressions", """
SELECT impression_id FROM impressions WHERE city_id = 7 AND query_type <> 4 AND length(query) >= 15""")
def filter_city_origin_len(spark, d):
    return tables.impressions(spark, d).where(
        (F.col("city_id") == 7) & (F.col("query_type") != 4) & (F.length("query") >= 15)
    ).select("impression_id")


@check("drop_prefix", "tabular", "SELECT id, target, seg_cat, nation_cat, bal FROM tabular")
def drop_prefix(spark, d):
    t = tables.tabular(spark, d)
    return t.drop(*[c for c in t.columns if c.startswith("ps_calc_")])


@check("select_columns", "clicks", "SELECT user_id, cid, isclk, dclk FROM clicks")
def select_columns(spark, d):
    return tables.clicks(spark, d).select("user_id", "cid", "isclk", "dclk")


def _features(spark, d):
    """Impressions with parsed features at some of the indexes that matter."""
    im = tables.impressions(spark, d)
    f = F.split("ltr_features", ";")
    cell = lambda i: F.get(F.split(F.get(f, i), ":"), 1)
    line = F.concat_ws(";", *[
        F.concat(F.lit(f"{i}:"), cell(at)) for i, at in ((1, 0), (25, 1), (28, 1), (36, 2), (62, 3), (66, 3))
    ])
    return im.withColumn("f", features.parse_features(line))


@check("ignore_features", "impressions", """
SELECT impression_id, '1,28,36,66' AS indexes FROM impressions""")
def ignore_features(spark, d):
    return _features(spark, d).select(
        "impression_id", ints(F.array_sort(F.map_keys(features.ignore(F.col("f"))))).alias("indexes")
    )


@check("densify_features", "impressions", """
SELECT impression_id, 530 AS width, show_pos AS s0, f1 AS s1, f2 AS s28, f3 AS s36, f4 AS s66,
  round(show_pos + f1 + 2 * f2 + f3 + 2 * f4, 4) AS total FROM impressions""")
def densify_features(spark, d):
    dense = features.densify(F.col("f"), F.col("show_pos"))
    x = _features(spark, d).select("impression_id", dense.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, e: s + e)
    return x.select(
        "impression_id", F.size("v").alias("width"), F.get("v", 0).cast("int").alias("s0"),
        *[F.get("v", i).alias(f"s{i}") for i in (1, 28, 36, 66)], F.round(total, 4).alias("total"),
    )


@check("feature_groups", "impressions", """
SELECT impression_id, CAST(round(f4 * 100) AS BIGINT)::STRING AS top, concat_ws(',', CAST(round(f2 * 100) AS BIGINT), CAST(round(f1 * 100) AS BIGINT), 0) AS raw
FROM impressions""")
def feature_groups(spark, d):
    pick = lambda indexes: features.pick_from(F.col("f"), F.col("show_pos"), indexes)
    return _features(spark, d).select("impression_id", scaled(pick([66]), 2).alias("top"), scaled(pick([28, 1, 30]), 2).alias("raw"))


@check("reindex_features", "impressions", """
SELECT impression_id, 215 AS width, f1 AS s1, round(f2 / 1000, 6) AS s28, f3 AS s36, f4 AS s66,
  round(len(list_intersect(string_split(query, ' '), string_split(replace(name_address, '|', ' '), ' '))) /
    len(list_distinct(string_split(query, ' '))), 6) AS match_ratio FROM impressions""")
def reindex_features(spark, d):
    _, ratio = text.token_overlap(F.col("query"), F.col("name_address"))
    x = _features(spark, d).select("impression_id", features.reindex(F.col("f"), ratio).alias("v"))
    at = features.reindex_table()
    slot = lambda old, name: F.get("v", at[old] - 1).alias(name)
    return x.select(
        "impression_id", F.size("v").alias("width"), slot(1, "s1"), F.round(F.get("v", at[28] - 1), 6).alias("s28"),
        slot(36, "s36"), slot(66, "s66"), F.round(F.element_at("v", -1), 6).alias("match_ratio"),
    )


@check("typed_output", "impressions", """
SELECT p_layer, count(*) AS n, count(DISTINCT p_poi_id) AS n_items FROM (
  SELECT CAST(layer AS STRING) AS p_layer, CAST(poi_id AS STRING) AS p_poi_id FROM impressions) GROUP BY p_layer""")
def typed_output(spark, d):
    # Rows are brought to the declared schema by name, type and order.
    specs = [f for f in fields.ITEM_FIELDS if f.source in ("p_poi_id", "p_layer", "p_show_pos")]
    rows = records.item_rows(_parsed(spark, d)).select(*[F.col(s.source) for s in reversed(specs)])
    typed = rows.to(fields.output_schema(specs))
    return typed.groupBy("p_layer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_poi_id").alias("n_items"))


@check("bbox_filter", "places", """
WITH b(country, min_lat, max_lat, min_lng, max_lng) AS (VALUES
  ('BR', -33.7684, 5.2718, -73.9822, -34.7933), ('MX', 14.5326, 32.7187, -117.1278, -86.7105),
  ('CO', -33.7684, 5.2718, -73.9822, -34.7933), ('CL', 14.5326, 32.7187, -117.1278, -86.7105))
SELECT poi_id, b.country FROM places p JOIN b ON b.country = ['BR', 'MX', 'CO', 'CL'][p.poi_id % 4 + 1]
WHERE lat BETWEEN min_lat AND max_lat AND lng BETWEEN min_lng AND max_lng""")
def bbox_filter(spark, d):
    names = F.array(*[F.lit(c) for c in geo.COUNTRY_BOXES])
    places = tables.places(spark, d).withColumn("country", F.get(names, F.pmod("poi_id", F.lit(4)).cast("int")))
    boxes = spark.createDataFrame(
        [(c, *b) for c, b in geo.COUNTRY_BOXES.items()],
        "country string, min_lat double, max_lat double, min_lng double, max_lng double",
    )
    return records.in_country_box(places, boxes).select("poi_id", "country")


@check("groups_with_positive", "impressions", """
SELECT impression_id FROM impressions WHERE search_uid IN (SELECT search_uid FROM impressions WHERE label = 2)""")
def groups_with_positive(spark, d):
    im = tables.impressions(spark, d)
    return records.groups_with(im, "search_uid", F.col("label") == 2).select("impression_id")


@check("derive_labels", "impressions", """
WITH s AS (SELECT impression_id, CASE label WHEN 2 THEN 'positive' WHEN 1 THEN 'hard_negative' ELSE 'negative' END AS kind FROM impressions)
SELECT impression_id, CASE WHEN kind IN ('positive', 'hard_negative') THEN 1 ELSE 0 END AS label,
  CASE WHEN kind = 'positive' THEN 1 ELSE 0 END AS origin_label FROM s""")
def derive_labels(spark, d):
    kind = F.when(F.col("label") == 2, "positive").when(F.col("label") == 1, "hard_negative").otherwise("negative")
    s = tables.impressions(spark, d).select("impression_id", kind.alias("kind"))
    return s.select(
        "impression_id", F.col("kind").isin("positive", "hard_negative").cast("int").alias("label"),
        (F.col("kind") == "positive").cast("int").alias("origin_label"),
    )


@check("task_labels", "order_log", """
SELECT impression_id, 'click' AS data_type, label - 1 AS click_label, 0 AS order_label FROM impressions
UNION ALL SELECT impression_id, 'order', label - 1, label - 1 FROM order_log""")
def task_labels(spark, d):
    click = tables.impressions(spark, d).select("impression_id", F.lit("click").alias("data_type"), "label")
    both = click.unionByName(tables.order_log(spark, d).select("impression_id", "data_type", "label"))
    return both.select("impression_id", "data_type", *records.task_labels(F.col("data_type"), F.col("label")))


@check("illegal_chars", "texts", """
SELECT doc_id FROM texts WHERE source <> 'src1' AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f]')""")
def illegal_chars(spark, d):
    # One source gets a bell character put into its texts.
    damaged = F.when(F.col("source") == "src1", F.concat(F.lit("a\x07"), "text")).otherwise(F.col("text"))
    docs = tables.texts(spark, d).withColumn("text", damaged)
    return docs.where(~text.has_control_chars(F.col("text"))).select("doc_id")


@check("field_registry", "places", """
SELECT poi_id, name_address AS plain, '[UNK]' AS geohash FROM places""")
def field_registry(spark, d):
    plain, unknown = fields.FieldSpec("plain"), fields.FieldSpec("geohash", parser="geohash")
    return tables.places(spark, d).select(
        "poi_id", fields.field_column(plain, F.col("name_address")),
        fields.field_column(unknown, F.lit(None).cast("string")),
    )


@check("operator_chain", "places", """
SELECT poi_id, layer + 1 AS layer, upper(category) AS category FROM places WHERE city_id < 20""")
def operator_chain(spark, d):
    operators = {
        "raise_layer": lambda df: df.withColumn("layer", F.col("layer") + 1),
        "shout": lambda df: df.withColumn("category", F.upper("category")),
        "drop_far": lambda df: df.where("city_id < 20"),
        "unused": lambda df: df.withColumn("layer", F.lit(0)),
    }
    enabled = ["raise_layer", "shout", "drop_far"]
    chained = reduce(lambda df, name: df.transform(operators[name]), enabled, tables.places(spark, d))
    return chained.select("poi_id", "layer", "category")
