"""Golden values of the scalar rules."""

import math

import pytest
from pyspark.sql import functions as F

from rankspark.functions import address, calendar, features, geo, text, tokens


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("ＡＢＣ　１２", "abc 12"), ("萬-_-里", "万 里"), ("  A  B  ", "a b"), ("", ""), ("x--y__z", "x y z"),
])
def test_normalise(spark, given, want):
    assert one(spark, text.normalise(F.col("s")), s=given) == want


def test_split_words(spark):
    assert one(spark, text.split_words(F.col("s")), s="ab12万 c#") == ["ab", "12", "万", " ", "c", "#"]


@pytest.mark.parametrize("rule, given, want", [
    (address.drop_repeated_symbols, "calle 5 # # 12 - - 3", "calle 5 # 12 - 3"),
    (address.number_symbol, "no 12 centro numero", "# 12 centro numero"),
    (address.drop_affixes, "av calle 10 sur", "calle 10"),
    (address.drop_affixes, "av 10 norte", "av 10 norte"),
])
def test_address_rules(spark, rule, given, want):
    assert one(spark, F.array_join(rule(F.split("s", " ")), " "), s=given) == want


@pytest.mark.parametrize("given, want", [
    ("calle 5 a", "calle 5a"), ("# 12 - 3", "#12-3"), ("a - 3", "a-3"), ("calle - 5", "calle -5"), ("5", "5"),
])
def test_glue(spark, given, want):
    assert one(spark, address.glue_tokens(F.split("s", " ")), s=given) == want


def test_address_chain(spark):
    got = one(spark, address.clean(F.split("s", " ")), s="av calle 5 a # # 12 - 3")
    assert got == "calle 5a #12-3"


@pytest.mark.parametrize("lat, lng, want", [
    (57.64911, 10.40744, "u4pruy"), (0.0, 0.0, "s00000"), (90.0, 180.0, "zzzzzz"), (91.0, 0.0, "[UNK]"),
])
def test_geohash(spark, lat, lng, want):
    assert one(spark, geo.geohash(F.col("a"), F.col("b")), a=lat, b=lng) == want


def test_haversine(spark):
    assert one(spark, geo.haversine_km(F.lit(2.3522), F.lit(48.8566), F.lit(-0.1278), F.lit(51.5074))) == pytest.approx(343.6, abs=0.5)


@pytest.mark.parametrize("given, want", [
    ("1:0.5;3:2", {1: 0.5, 3: 2.0}), ("0.5;0;2;", {1: 0.5, 2: 0.0, 3: 2.0}), ("1:1;1:2", {1: 2.0}),
    ("530:1;2:3", {2: 3.0}), ("null", None), ("nullLtrFeatures", None), ("1:0.123456789", {1: 0.1234568}),
])
def test_parse_features(spark, given, want):
    assert one(spark, features.parse_features(F.col("s")), s=given) == want


@pytest.mark.parametrize("given, want", [
    ("2:5;4:7", [9.0, 0.0, 5.0, 0.0, 7.0]), ("4:7;1:1", [9.0, 1.0, 0.0, 0.0, 7.0]), ("0:3", [9.0, 0.0, 0.0, 0.0, 0.0]),
])
def test_densify(spark, given, want):
    assert one(spark, features.densify(features.parse_features(F.col("s")), F.lit(9), 4), s=given) == want


def test_reindex_table():
    table = features.reindex_table()
    assert len(table) == 33 and table[1] == 1 and table[36] == 28 and table[64] == 29 and table[68] == 33
    assert not {16, 25, 27, 29, 30, 33, 34, 35} & set(table)


def test_median_ratio_log(spark):
    f = lambda x, m, lo: one(spark, features.median_ratio_log(F.lit(x), F.lit(m), F.lit(lo)))
    assert f(5.0, 1.8284, -1.0) == round(math.log((1 + 6.0) / (1 + 2.8284)), 4)
    assert f(-1.0, 1.8284, -1.0) == 0.0 and f(3.0, 0.0, 0.0) == 0.0


@pytest.mark.parametrize("a, b, n", [(3, 9, 7), (9, 3, 7), (9, 9, 7), (9, 9, 8), (2, 2, 7), (0, 9, 4), (5, 6, 10)])
def test_truncate_pair(spark, a, b, n):
    x, y = list(range(a)), list(range(b))
    while len(x) + len(y) > n:
        (x if len(x) > len(y) else y).pop()
    ca, cb = tokens.truncate_pair(F.col("a"), F.col("b"), n)
    row = spark.range(1).select(
        F.slice(F.sequence(F.lit(0), F.lit(20)), 1, a).alias("a"), F.slice(F.sequence(F.lit(0), F.lit(20)), 1, b).alias("b")
    ).select(ca.alias("x"), cb.alias("y")).first()
    assert (row.x, row.y) == (x, y)


def test_encode(spark):
    e = one(spark, tokens.encode(F.col("i"), 5), i=[7, 8, 9, 10])
    assert (e.token_ids, e.segment_ids, e.mask_ids) == ([4, 7, 8, 9, 5], [0] * 5, [1] * 5)
    e = one(spark, tokens.encode(F.col("i"), 5), i=[7])
    assert (e.token_ids, e.mask_ids) == ([4, 7, 5, 0, 0], [1, 1, 1, 0, 0])


def test_pair_segments(spark):
    e = one(spark, tokens.pair_segments(F.col("i"), 8), i=[4, 7, 5, 8, 5])
    assert e.segment_ids == [0, 0, 0, 1, 1, 0, 0, 0] and e.mask_ids == [1] * 5 + [0] * 3


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, calendar.days_between(d("2023-02-27"), d("2023-03-01"))) == ["20230227", "20230228", "20230301"]
    assert one(spark, calendar.days_between(d("2023-03-02"), d("2023-03-01"))) == []
    assert one(spark, calendar.days_before(F.lit("20230301"), 1)) == "20230228"
    assert one(spark, calendar.hour_bucket(calendar.hour_of(F.lit("2023-03-01 05:59:00")))) == 2


def test_position_weight(spark):
    got = [one(spark, features.position_weight(F.lit(r).cast("int"))) for r in (0, 3, 9, 50, None)]
    assert got == pytest.approx([-0.313, 0.0, 0.127, 0.127, 0.127])
