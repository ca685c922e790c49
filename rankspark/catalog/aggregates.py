"""Aggregation, dictionary, profile and sampling checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark import fields
from rankspark.catalog.joins import item_index
from rankspark.catalog.registry import check, ints
from rankspark.functions import features
from rankspark.operators import dictionary, groups, profile, records, sampling, skew
from rankspark.sources import tables


@check("dedup_search", "impressions", """
SELECT search_uid, count(*) AS n_items FROM impressions GROUP BY search_uid""")
def dedup_search(spark, d):
    # Searches of one side were logged twice; the log is made once.
    copies = F.array_repeat(F.lit(0), F.when(F.col("country_code") == "ASIA", 2).otherwise(1))
    twice = tables.search_log(spark, d).withColumn("copy", F.explode(copies)).drop("copy")
    parsed = records.parse_log(records.dedup_lines(twice))
    return parsed.groupBy("search_uid").agg(F.sum(F.size("items")).alias("n_items"))


@check("dedup_items", "impressions", """
WITH f AS (SELECT * FROM impressions QUALIFY row_number() OVER (PARTITION BY search_uid, layer ORDER BY show_pos, impression_id) = 1)
SELECT search_uid, layer, impression_id, count(*) OVER (PARTITION BY search_uid) AS group_len FROM f""")
def dedup_items(spark, d):
    order = [F.col("show_pos"), F.col("impression_id")]
    im = tables.impressions(spark, d).select("search_uid", "layer", "show_pos", "impression_id")
    return groups.dedup_items(im, "search_uid", "layer", order).select(
        "search_uid", "layer", "impression_id", "group_len"
    )


@check("collect_group", "impressions", """
WITH n AS (SELECT search_uid, impression_id, show_pos, (row_number() OVER (PARTITION BY search_uid ORDER BY show_pos, impression_id) - 1) // 4 AS page FROM impressions)
SELECT search_uid, page, string_agg(impression_id, ',' ORDER BY show_pos, impression_id) AS items FROM n GROUP BY search_uid, page""")
def collect_group(spark, d):
    g = groups.gather(
        tables.impressions(spark, d).select("search_uid", "show_pos", "impression_id"), ["search_uid"],
        [F.col("show_pos"), F.col("impression_id")], F.col("impression_id"), page_rows=4,
    )
    return g.withColumn("items", ints("items"))


SQL_COUNTS = """
counts AS (SELECT 'uid' AS dict_key, CAST(uid AS STRING) AS value, count(*) AS cnt FROM impressions GROUP BY ALL
  UNION ALL SELECT 'poiid', CAST(poi_id AS STRING), count(*) FROM impressions GROUP BY ALL
  UNION ALL SELECT 'layer', CAST(layer AS STRING), count(*) FROM impressions GROUP BY ALL
  UNION ALL SELECT 'trigram', g, count(*) FROM (
    SELECT unnest([substring(t, i, 3) for i in range(1, length(t) - 1)]) AS g FROM (
      SELECT unnest([lower(query), lower(name_address)]) AS t FROM impressions)) GROUP BY ALL)"""


def _counts(spark, d):
    from rankspark.functions import text

    im = tables.impressions(spark, d)
    grams = [dictionary.Terms(F.col(c), text.char_trigrams) for c in ("query", "name_address")]
    return im, dictionary.value_counts(
        im, {"uid": [F.col("uid")], "poiid": [F.col("poi_id")], "layer": [F.col("layer")], "trigram": grams}
    )


@check("value_frequency", "impressions", f"WITH {SQL_COUNTS} SELECT * FROM counts")
def value_frequency(spark, d):
    return _counts(spark, d)[1]


@check("frequency_filter", "impressions", f"""
WITH {SQL_COUNTS} SELECT * FROM counts WHERE NOT (dict_key = 'uid' AND cnt <= 40) AND NOT (dict_key = 'poiid' AND cnt <= 30)""")
def frequency_filter(spark, d):
    return dictionary.filter_by_count(_counts(spark, d)[1], {"uid": 40, "poiid": 30})


@check("unk_rows", "impressions", """
SELECT unnest(['uid', 'poiid', 'layer', 'trigram']) AS dict_key, 'UNK' AS value, (SELECT count(*) FROM impressions) AS cnt""")
def unk_rows(spark, d):
    return dictionary.unknown_rows(tables.impressions(spark, d), ["uid", "poiid", "layer", "trigram"])


@check("dictionary_encode", "impressions", f"""
WITH {SQL_COUNTS} SELECT dict_key, value, CAST(row_number() OVER (PARTITION BY dict_key ORDER BY cnt DESC, value) AS INT) AS idx FROM counts""")
def dictionary_encode(spark, d):
    return dictionary.number(_counts(spark, d)[1])


@check("row_count", "impressions", "SELECT count(*) AS n FROM impressions")
def row_count(spark, d):
    return tables.impressions(spark, d).agg(F.count(F.lit(1)).alias("n"))


@check("distinct_groups", "impressions", "SELECT count(DISTINCT search_uid) AS n FROM impressions")
def distinct_groups(spark, d):
    return tables.impressions(spark, d).agg(F.count_distinct("search_uid").alias("n"))


@check("class_balance", "clicks", "SELECT isclk, count(*) AS n FROM clicks GROUP BY isclk")
def class_balance(spark, d):
    return tables.clicks(spark, d).groupBy("isclk").agg(F.count(F.lit(1)).alias("n"))


def _sql_describe(table, columns):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table}""" for c in columns)


@check("describe_columns", "clicks tabular", f"{_sql_describe('clicks', ['isclk', 'dclk', 'hr'])} UNION ALL {_sql_describe('tabular', ['bal'])}")
def describe_columns(spark, d):
    both = profile.describe(tables.clicks(spark, d), ["isclk", "dclk", "hr"]).unionByName(
        profile.describe(tables.tabular(spark, d), ["bal"])
    )
    return both.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@check("column_info", "tabular", """
SELECT unnest(['id', 'target', 'seg_cat', 'nation_cat', 'bal', 'ps_calc_01']) AS "column",
  unnest(['bigint', 'int', 'string', 'int', 'double', 'bigint']) AS type,
  unnest([count(id), count(target), count(seg_cat), count(nation_cat), count(bal), count(ps_calc_01)]) AS n_present FROM tabular""")
def column_info(spark, d):
    t = tables.tabular(spark, d)
    types = F.create_map(*[F.lit(x) for pair in t.dtypes for x in pair])
    return profile.per_column(t, t.columns, n_present=F.count).withColumn("type", types[F.col("column")])


@check("corr_matrix", "clicks", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM clicks"
    for a in ("isclk", "dclk", "hr") for b in ("isclk", "dclk", "hr")))
def corr_matrix(spark, d):
    return profile.correlations(tables.clicks(spark, d), ["isclk", "dclk", "hr"]).withColumn("corr", F.round("corr", 6))


@check("missing_report", "tabular", """
SELECT * FROM (SELECT 'nation_cat' AS "column", count(*) FILTER (nation_cat IS NULL) AS missing,
  round(count(*) FILTER (nation_cat IS NULL) / count(*), 6) AS share FROM tabular
UNION ALL SELECT 'bal', count(*) FILTER (bal IS NULL), round(count(*) FILTER (bal IS NULL) / count(*), 6) FROM tabular)
WHERE missing > 0""")
def missing_report(spark, d):
    return profile.missing_report(tables.tabular(spark, d)).withColumn("share", F.round("share", 6))


def _sql_mode(c):
    return f"(SELECT {c} FROM tabular WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@check("impute_mode", "tabular", f"""
SELECT id, seg_cat, coalesce(nation_cat, {_sql_mode('nation_cat')}) AS nation_cat, coalesce(bal, {_sql_mode('bal')}) AS bal FROM tabular""")
def impute_mode(spark, d):
    return profile.impute_mode(tables.tabular(spark, d), ["nation_cat", "bal"]).select("id", "seg_cat", "nation_cat", "bal")


@check("cardinality_report", "tabular", """
SELECT 'seg_cat' AS "column", count(DISTINCT seg_cat) AS n_distinct, count(DISTINCT seg_cat) < 50 AS is_small FROM tabular
UNION ALL SELECT 'nation_cat', count(DISTINCT nation_cat), count(DISTINCT nation_cat) < 50 FROM tabular
UNION ALL SELECT 'bal', count(DISTINCT bal), count(DISTINCT bal) < 50 FROM tabular""")
def cardinality_report(spark, d):
    return profile.cardinalities(tables.tabular(spark, d), ["seg_cat", "nation_cat", "bal"])


@check("histogram50", "clicks", """
WITH r AS (SELECT min(dclk) AS lo, (max(dclk) - min(dclk)) / 50 AS w FROM clicks)
SELECT CAST(least(floor((dclk - lo) / w), 49) AS INT) AS bin, count(*) AS n FROM clicks, r GROUP BY 1""")
def histogram50(spark, d):
    return profile.histogram(tables.clicks(spark, d), "dclk")


@check("boxplot_stats", "clicks", """
WITH q AS (SELECT quantile_cont(dclk, 0.25) AS a, quantile_cont(dclk, 0.5) AS b, quantile_cont(dclk, 0.75) AS c FROM clicks)
SELECT round(a, 6) AS q25, round(b, 6) AS q50, round(c, 6) AS q75, round(a - 1.5 * (c - a), 6) AS low_fence,
  round(c + 1.5 * (c - a), 6) AS high_fence,
  count(*) FILTER (dclk < a - 1.5 * (c - a) OR dclk > c + 1.5 * (c - a)) AS n_outliers FROM clicks, q GROUP BY ALL""")
def boxplot_stats(spark, d):
    b = profile.box_plot(tables.clicks(spark, d), "dclk")
    return b.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75", "low_fence", "high_fence")})


@check("group_lengths", "impressions", "SELECT search_uid, count(*) AS group_len FROM impressions GROUP BY search_uid")
def group_lengths(spark, d):
    return groups.group_lengths(tables.impressions(spark, d), "search_uid")


@check("feature_stats", "impressions", """
WITH f AS (SELECT unnest([1, 2, 3, 4]) AS idx, unnest([f1, f2, f3, f4]) AS v FROM impressions)
SELECT idx, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, min(v) AS low, max(v) AS high,
  round(median(v), 9) AS median FROM f GROUP BY idx""")
def feature_stats(spark, d):
    parsed = features.parse_features(F.col("ltr_features"))
    long = tables.impressions(spark, d).select(F.explode(parsed).alias("idx", "value"))
    stats = profile.feature_statistics(long).join(profile.group_medians(long, "idx", "value"), "idx")
    return stats.withColumns({c: F.round(c, 9) for c in ("mean", "std", "median")})


@check("city_counts", "places", """
WITH n AS (SELECT city_id, poi_id, (row_number() OVER (PARTITION BY city_id ORDER BY poi_id) - 1) // 50 AS page,
  count(*) OVER (PARTITION BY city_id) AS n_items FROM places)
SELECT city_id, n_items, page, string_agg(poi_id, ',' ORDER BY poi_id) AS items FROM n GROUP BY ALL""")
def city_counts(spark, d):
    places = tables.places(spark, d)
    lists = groups.gather(places, ["city_id"], [F.col("poi_id")], F.col("poi_id"), page_rows=50)
    sized = skew.attach(lists, groups.group_lengths(places, "city_id", "n_items"), ["city_id"])
    return sized.withColumn("items", ints("items"))


@check("mean_predictions", "impressions", """
SELECT search_uid, round(avg(p), 6) AS prediction FROM (
  SELECT search_uid, sqrt(f2) AS p FROM impressions UNION ALL SELECT search_uid, f1 FROM impressions) GROUP BY search_uid""")
def mean_predictions(spark, d):
    # Two models' predictions side by side in long form.
    im = tables.impressions(spark, d).withColumn("f", features.parse_features(F.col("ltr_features")))
    models = F.array(F.sqrt(F.try_element_at("f", F.lit(2))), F.try_element_at("f", F.lit(1)))
    return im.select("search_uid", F.explode(models).alias("p")).groupBy("search_uid").agg(
        F.round(F.avg("p"), 6).alias("prediction")
    )


@check("item_index", "places", "SELECT poi_id, row_number() OVER (ORDER BY poi_id) - 1 AS idx FROM places")
def item_index_query(spark, d):
    return item_index(tables.places(spark, d))


# ---------------------------------------------------------------- sampling

SQL_HASH = "CAST('0x' || substr(md5(CAST({key} AS STRING) || '#{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


@check("sample_fraction", "impressions", f"""
SELECT impression_id FROM impressions
WHERE {SQL_HASH.format(key='impression_id', seed=12357)} < 1.8 * 5000 / (SELECT count(*) FROM impressions)""")
def sample_fraction(spark, d):
    im = tables.impressions(spark, d)
    return sampling.sample(im, F.col("impression_id"), 5000, factor=sampling.CLICK_FACTOR).select("impression_id")


@check("stratified_sample", "impressions", """
WITH r AS (SELECT impression_id, country_code, count(*) OVER (PARTITION BY country_code) AS n,
  row_number() OVER (PARTITION BY country_code ORDER BY md5(impression_id || '#12357'), impression_id) AS rn FROM impressions)
SELECT impression_id, country_code FROM r WHERE n < 1000 OR country_code = 'ASIA' OR rn <= floor(n / 4)""")
def stratified_sample(spark, d):
    im = tables.impressions(spark, d).select("impression_id", "country_code")
    return sampling.stratified_quarter(im, "country_code", F.col("impression_id"), "ASIA")


@check("train_test_split", "clicks", f"""
SELECT cid, CASE WHEN {SQL_HASH.format(key='cid', seed=12357)} < 0.25 THEN 'test' ELSE 'train' END AS part FROM clicks""")
def train_test_split(spark, d):
    return tables.clicks(spark, d).select("cid", sampling.train_test(F.col("cid")).alias("part"))


@check("stratified_kfold", "tabular", """
SELECT id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY md5(CAST(id AS STRING) || '#2016'), id) - 1) % 5 AS INT) AS fold FROM tabular""")
def stratified_kfold(spark, d):
    return sampling.stratified_folds(tables.tabular(spark, d).select("id", "target"), "target", F.col("id"))
