"""The union job: lists made once for each text, and the text form of dense values."""

from pyspark.sql import functions as F

from rankspark.catalog.registry import ints, scaled, scaled_text
from rankspark.functions import features
from rankspark.operators import encoding
from rankspark.plans import jobs

TEXTS = [("red green box", "box red|small"), (None, "a|b|c"), ("blue 7", None), ("", "|")]
MAPS = [{1: 2.5, 28: 1500.0, 2: -1.0, 40: 0.00012}, None, {}, {3: -1.5, 4: 1e12, 5: None, 64: 3.0}]


def union(spark, n, **forms):
    rows = [(str(i), *TEXTS[i % 4], i % 2, "2020-01-01 07:00:00", i % 3, i % 3, "pos", i, MAPS[i // 4 % 4], 1.0, 2.0, 3.0, i / 10) for i in range(n)]
    rows = spark.createDataFrame(rows, """impression_id string, query string, name_address string, query_type int, time_text string, layer int,
        label int, sample_type string, poi_id long, f map<int,double>, lng double, lat double, item_lng double, item_lat double""").withColumn("search_uid", F.lit("s"))
    words = spark.createDataFrame([("red green box blue small a",)], "text string")
    return jobs.union_rows(rows, encoding.build_vocabulary(words), None, {"common_total": F.col("layer")}, None, F.col("layer"), **forms)


def test_forms_show_what_the_lists_hold(spark):
    names = ["dense", *jobs.UNION_QUERY, *jobs.UNION_POI]
    plain = union(spark, 64).withColumns({"dense": scaled("dense"), **{c: ints(c) for c in names[1:]}})
    shown = union(spark, 64, form=ints, dense_form=scaled_text)
    rows = lambda df: sorted(df.select("impression_id", *names).collect())
    assert rows(plain) == rows(shown) and len(rows(shown)) == 64


def test_lists_are_made_once_for_each_text(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(ids):
        calls.add(1)
        return ",".join(map(str, ids))

    out = union(spark, 400, form=F.udf(count, "string").asNondeterministic()).select("impression_id", *jobs.UNION_QUERY, *jobs.UNION_POI)
    assert len(out.collect()) == 400
    assert calls.value <= 4 * len(TEXTS) * 6


def test_dense_text_without_features_is_constant(spark):
    m = spark.createDataFrame([(x, 0.25) for x in MAPS if x is not None], "f map<int,double>, r double")
    lists = scaled(features.dense_log2(features.reindex(F.col("f"), F.col("r"))))
    text = features.reindex_text(F.col("f"), F.col("r"), scaled_text)
    got = m.select(lists.alias("a"), text.alias("b"))
    assert all(r.a == r.b for r in got.collect())
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = m.select(text)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert ",".join(["0"] * 100) in plan and plan.count("try_element_at") < 100
