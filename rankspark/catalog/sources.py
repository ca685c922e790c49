"""Source and sink checks: each writes what it reads to the shared folder first."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rankspark.catalog.registry import check, ints, scaled
from rankspark.functions import features
from rankspark.operators import dictionary, profile, records
from rankspark.session import new_path
from rankspark.sources import files, logs, tables

SQL_LOG = """
log AS (SELECT search_uid, date_trunc('month', min(dt))::DATE AS dt, min(country_code) AS country_code, count(*) AS n_items
  FROM impressions GROUP BY search_uid)"""


def stored_log(spark, d):
    path = new_path(spark, "log")
    logs.write_log(tables.search_log(spark, d), path)
    return path


@check("scan_partition_range", "impressions", f"""
WITH {SQL_LOG}
SELECT search_uid, dt, n_items FROM log WHERE dt BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND country_code = 'ASIA'""")
def scan_partition_range(spark, d):
    log = logs.scan_log(spark, stored_log(spark, d), "1994-01-01", "1997-12-31", "ASIA")
    return records.parse_log(log).groupBy("search_uid", F.col("dt").cast("date").alias("dt")).agg(
        F.sum(F.size("items")).alias("n_items")
    )


@check("date_partitions", "impressions", f"""
WITH {SQL_LOG}
SELECT dt, country_code, count(*) AS n_searches FROM log
WHERE dt BETWEEN DATE '1993-01-01' AND DATE '1998-12-31' AND dt <> DATE '1995-03-01' GROUP BY ALL""")
def date_partitions(spark, d):
    log = logs.scan_log(
        spark, stored_log(spark, d), "1993-01-01", "1998-12-31", skip_days=("19950301",)
    )
    return log.where("page = 0").groupBy(F.col("dt").cast("date").alias("dt"), "country_code").agg(
        F.count(F.lit(1)).alias("n_searches")
    )


@check("scan_click_sessions", "impressions", """
SELECT search_uid, count(*) AS n_clicks FROM impressions
WHERE label = 2 AND country_code = 'EUROPE' AND date_trunc('month', dt) BETWEEN DATE '1993-01-01' AND DATE '1998-12-01'
GROUP BY search_uid""")
def scan_click_sessions(spark, d):
    log = logs.scan_log(spark, stored_log(spark, d), "1993-01-01", "1998-12-01", "EUROPE")
    clicked = records.keep_labelled(F.col("items"), 2)
    return (
        records.parse_log(log).select("search_uid", F.size(clicked).alias("n")).where("n > 0")
        .groupBy("search_uid").agg(F.sum("n").alias("n_clicks"))
    )


@check("scan_text_lines", "impressions", """
SELECT split_part(impression_id, '-', 1)::BIGINT AS search_id, impression_id, label FROM impressions""")
def scan_text_lines(spark, d):
    path = new_path(spark, "lines")
    im = tables.impressions(spark, d)
    im.select(
        F.concat_ws("\t", "search_id", "impression_id", "label").alias("value"), "country_code"
    ).write.partitionBy("country_code").text(path)
    parts = F.split("value", "\t")
    return files.scan_text(spark, path).select(
        F.get(parts, 0).cast("bigint").alias("search_id"), F.get(parts, 1).alias("impression_id"),
        F.get(parts, 2).cast("int").alias("label"),
    )


TABULAR_SCHEMA = "id bigint, target int, seg_cat string, nation_cat int, bal double, ps_calc_01 bigint"


def _delimited(spark, d, sep):
    path = new_path(spark, "table")
    tables.tabular(spark, d).write.csv(path, header=True, sep=sep)
    return files.scan_csv(spark, path, TABULAR_SCHEMA, sep)


@check("scan_csv", "tabular", "SELECT * FROM tabular")
def scan_csv(spark, d):
    return _delimited(spark, d, ",")


@check("scan_tsv", "tabular", "SELECT * FROM tabular")
def scan_tsv(spark, d):
    return _delimited(spark, d, "\t")


@check("scan_libsvm", "impressions", """
SELECT label, f1, f2, f3, f4, count(*) AS n FROM impressions GROUP BY ALL""")
def scan_libsvm(spark, d):
    path = new_path(spark, "libsvm")
    tables.impressions(spark, d).select(
        F.concat_ws(" ", F.col("label").cast("string"), F.replace("ltr_features", F.lit(";"), F.lit(" "))).alias("value")
    ).write.text(path)
    v = F.col("v")
    return files.scan_libsvm(spark, path, 4).select(
        F.col("label").cast("int").alias("label"), vector_to_array("features").alias("v")
    ).groupBy("label", *[F.get(v, i - 1).alias(f"f{i}") for i in range(1, 5)]).agg(F.count(F.lit(1)).alias("n"))


SQL_BRAND_DICTIONARY = """
SELECT 'brand' AS dict_key, p_brand AS value, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INT) AS idx
FROM part GROUP BY p_brand"""


@check("load_dictionary", "", SQL_BRAND_DICTIONARY)
def load_dictionary(spark, d):
    path = new_path(spark, "dictionary")
    counts = tables.table(spark, d, "part").groupBy(F.lit("brand").alias("dict_key"), F.col("p_brand").alias("value")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    files.write_lines(dictionary.number(counts), path, "idx", F.concat_ws("||", "value", "dict_key"))
    return files.load_dictionary(spark, path)


@check("load_feature_stats", "impressions", """
WITH f AS (SELECT unnest([1, 2, 3, 4]) AS idx, unnest([f1, f2, f3, f4]) AS v FROM impressions)
SELECT CAST(idx AS STRING) AS key, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std,
  round(min(v), 9) AS low, round(max(v), 9) AS high FROM f GROUP BY idx""")
def load_feature_stats(spark, d):
    path = new_path(spark, "stats")
    long = tables.impressions(spark, d).select(F.explode(features.parse_features(F.col("ltr_features"))).alias("idx", "value"))
    stats = profile.feature_statistics(long)
    files.write_lines(
        stats.unionByName(stats.withColumn("high", F.lit(None).cast("double"))), path,
        *[F.col(c).cast("string") for c in ("idx", "mean", "std", "low", "high")],
    )
    return files.load_feature_stats(spark, path).select(
        "key", *[F.round(c, 9).alias(c) for c in ("mean", "std", "low", "high")]
    )


@check("parse_delimited", "places", """
SELECT city_id, poi_id, name, addr, layer FROM places""")
def parse_delimited(spark, d):
    # One line per city page: items joined by a double bar, their fields by ##.
    path = new_path(spark, "records")
    p = tables.places(spark, d)
    paged = p.withColumn("line", F.floor(F.col("poi_id") / 500))
    item = F.concat_ws("##", "poi_id", "name", "addr", "layer")
    files.write_lines(
        paged.groupBy("city_id", "line").agg(F.array_join(F.collect_list(item), "||").alias("items")),
        path, F.col("city_id").cast("string"), "items",
    )
    cells = F.split("value", "\t")
    rows = files.scan_text(spark, path).select(
        F.get(cells, 0).cast("int").alias("city_id"), F.explode(F.split(F.get(cells, 1), r"\|\|")).alias("item")
    )
    f = F.slice(F.split("item", "##"), 1, 4)
    return rows.select(
        "city_id", F.get(f, 0).cast("bigint").alias("poi_id"), F.get(f, 1).alias("name"),
        F.get(f, 2).alias("addr"), F.get(f, 3).cast("int").alias("layer"),
    )


@check("parse_json", "impressions", """
WITH q AS (SELECT search_uid, min(query) AS query FROM impressions GROUP BY search_uid)
SELECT search_uid, q.query, CAST(city_id AS STRING) AS area, impression_id, CAST(poi_id AS STRING) AS poi_id, label
FROM impressions JOIN q USING (search_uid)""")
def parse_json(spark, d):
    return records.parse_log(tables.search_log(spark, d)).select(
        "search_uid", F.col("q.g_disp_query").alias("query"), F.col("q.g_disp_area").alias("area"),
        F.explode("items").alias("i"),
    ).select(
        "search_uid", "query", "area", F.col("i.p_impression_id").alias("impression_id"),
        F.col("i.p_poi_id").alias("poi_id"), F.col("i.p_label").cast("int").alias("label"),
    )


@check("sink_text", "impressions", "SELECT 20 AS n_files, search_uid, count(*) AS n_lines FROM impressions GROUP BY search_uid")
def sink_text(spark, d):
    path = new_path(spark, "lines")
    files.write_lines(tables.impressions(spark, d), path, "search_uid", F.col("label").cast("string"), partitions=20)
    back = files.scan_text(spark, path).select("value", F.input_file_name().alias("file"))
    n_files = back.select("file").distinct().count()
    return back.groupBy(F.get(F.split("value", "\t"), 0).alias("search_uid")).agg(
        F.count(F.lit(1)).alias("n_lines")
    ).withColumn("n_files", F.lit(n_files))


@check("sink_examples", "impressions", "SELECT impression_id, label, round(score, 9) AS score FROM impressions")
def sink_examples(spark, d):
    path = new_path(spark, "examples")
    files.write_examples(tables.impressions(spark, d).select("impression_id", "label", "score"), path)
    return spark.read.parquet(path).select("impression_id", "label", F.round("score", 9).alias("score"))


@check("sink_single", "impressions", "SELECT country_code, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM impressions GROUP BY country_code")
def sink_single(spark, d):
    path = new_path(spark, "merged")
    files.write_compact(tables.impressions(spark, d).select("country_code", "label"), path)
    return spark.read.parquet(path).groupBy("country_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels")
    )


@check("sink_csv6", "impressions", """
SELECT impression_id, printf('%.6f', sqrt(score)) AS score FROM impressions""")
def sink_csv6(spark, d):
    path = new_path(spark, "csv")
    files.write_csv6(tables.impressions(spark, d).select("impression_id", F.sqrt("score").alias("score")), path)
    return files.scan_csv(spark, path, "impression_id string, score string")


@check("vector_json", "vectors", """
SELECT vec_id AS poi_id, city_id, array_to_string(list_transform(embedding,
  lambda x: CAST(CAST(round(x * 100000000) AS BIGINT) AS STRING)), ',') AS vector FROM vectors""")
def vector_json(spark, d):
    path = new_path(spark, "vectors")
    files.write_vectors(
        tables.vectors(spark, d).select(F.col("vec_id").alias("poi_id"), "city_id", F.col("embedding").alias("vector")), path
    )
    return files.read_vectors(spark, path).withColumn("vector", scaled("vector", 8))


@check("vectors_typed_union", "vectors", """
SELECT doctype, vec_id, city_id, round(embedding[1], 6) AS v1 FROM vectors WHERE doctype = 'doc'
UNION ALL SELECT doctype, vec_id, city_id, round(embedding[1], 6) FROM vectors WHERE doctype = 'query'""")
def vectors_typed_union(spark, d):
    v = tables.vectors(spark, d)
    part = lambda t: v.where(F.col("doctype") == t).select(
        "vec_id", "city_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("vector")
    )
    path = new_path(spark, "typed")
    both = files.typed_vectors(part("query"), part("doc"))
    files.write_lines(both, path, "doctype", F.col("vec_id").cast("string"), F.col("city_id").cast("string"), "vector")
    cells = F.split("value", "\t")
    rows = records.min_fields(files.scan_text(spark, path), 4).select(
        F.get(cells, 0).alias("doctype"), F.get(cells, 1).cast("bigint").alias("vec_id"),
        F.get(cells, 2).cast("int").alias("city_id"),
        F.round(F.get(F.split(F.get(cells, 3), ","), 0).cast("double"), 6).alias("v1"),
    )
    return rows.where("doctype = 'query'").unionByName(rows.where("doctype = 'doc'"))


@check("sample_projections", "impressions", """
SELECT 'lengths' AS kind, search_uid AS k, count(*) AS n, 0 AS s FROM impressions GROUP BY search_uid
UNION ALL SELECT 'labels', CAST(label AS STRING), count(*), CAST(sum(label) AS BIGINT) FROM impressions GROUP BY label
UNION ALL SELECT 'features', CAST(label AS STRING), count(*), CAST(sum(f1) AS BIGINT) FROM impressions GROUP BY label""")
def sample_projections(spark, d):
    im = tables.impressions(spark, d)
    whole = im.select("search_uid", "label", features.parse_features(F.col("ltr_features")).alias("f"))
    lengths = whole.groupBy(F.lit("lengths").alias("kind"), F.col("search_uid").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("s")
    )
    by_label = lambda kind, value: whole.groupBy(F.lit(kind).alias("kind"), F.col("label").cast("string").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).cast("bigint").alias("s")
    )
    return lengths.unionByName(by_label("labels", F.col("label"))).unionByName(
        by_label("features", F.try_element_at("f", F.lit(1)))
    )


@check("route_predictions", "impressions", """
SELECT CASE WHEN query_type = 4 THEN 'start' ELSE 'end' END AS side, impression_id, round(score, 9) AS score FROM impressions""")
def route_predictions(spark, d):
    path = new_path(spark, "routed")
    files.route_predictions(tables.impressions(spark, d).select("impression_id", "query_type", "score"), path)
    back = spark.read.parquet(path)
    one = lambda side: back.where(F.col("side") == side).select("side", "impression_id", F.round("score", 9).alias("score"))
    return one("start").unionByName(one("end"))


@check("merge_shuffle", "impressions", """
SELECT country_code, count(*) AS n, count(DISTINCT impression_id) AS n_ids, CAST(sum(label) AS BIGINT) AS labels FROM impressions GROUP BY country_code""")
def merge_shuffle(spark, d):
    path = new_path(spark, "countries")
    tables.impressions(spark, d).select("impression_id", "label", "country_code").write.partitionBy("country_code").parquet(path)
    mixed = files.shuffle_rows(spark.read.parquet(path), F.col("impression_id"), 12357)
    return mixed.groupBy("country_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("impression_id").alias("n_ids"), F.sum("label").alias("labels")
    )


@check("read_examples_checked", "impressions", """
SELECT impression_id, CAST(show_pos AS STRING) || ',' || CAST(f1 AS BIGINT) AS dense FROM impressions""")
def read_examples_checked(spark, d):
    path = new_path(spark, "examples")
    im = tables.impressions(spark, d).withColumn("f", features.parse_features(F.col("ltr_features")))
    files.write_examples(im.select("impression_id", features.densify(F.col("f"), F.col("show_pos"), 4).alias("dense")), path)
    back = files.read_examples(spark, path, {"dense": 5})
    return back.select("impression_id", ints(F.transform(F.slice("dense", 1, 2), lambda x: x.cast("bigint"))).alias("dense"))
