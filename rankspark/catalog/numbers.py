"""Number, geo, vector and token-sequence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.catalog.registry import check, ints, scaled
from rankspark.functions import features, geo, tokens, vectors
from rankspark.operators import dictionary, encoding, profile
from rankspark.operators.skew import attach
from rankspark.sources import tables


def _long_features(spark, d):
    f = features.parse_features(F.col("ltr_features"))
    return tables.impressions(spark, d).select("impression_id", F.explode(f).alias("idx", "value"))


@check("median_ratio_log", "impressions", """
WITH f AS (SELECT impression_id, unnest([1, 2, 3, 4]) AS idx, unnest([f1, f2, f3, f4]) AS v FROM impressions),
s AS (SELECT idx, median(v) AS med, min(v) AS lo FROM f GROUP BY idx)
SELECT impression_id, idx, CASE WHEN v - lo <= 0 OR med - lo <= 0 THEN 0
  ELSE round(ln((1 + v - lo) / (1 + med - lo)), 4) END AS value FROM f JOIN s USING (idx)""")
def median_ratio_log(spark, d):
    long = _long_features(spark, d)
    stats = profile.feature_statistics(long).join(profile.group_medians(long, "idx", "value"), "idx")
    joined = attach(long, stats.select("idx", "median", "low"), ["idx"])
    return joined.select(
        "impression_id", "idx", features.median_ratio_log(F.col("value"), F.col("median"), F.col("low")).alias("value")
    )


@check("zscore", "impressions", """
WITH f AS (SELECT impression_id, unnest([1, 2, 3, 4]) AS idx, unnest([f1, f2, f3, f4]) AS v FROM impressions),
s AS (SELECT idx, avg(v) AS m, stddev_pop(v) AS sd FROM f WHERE idx <> 4 GROUP BY idx)
SELECT impression_id, idx, round(CASE WHEN sd IS NULL THEN v WHEN sd <= 0.000001 THEN 0 ELSE (v - m) / sd END, 6) AS value
FROM f LEFT JOIN s USING (idx)""")
def zscore(spark, d):
    long = _long_features(spark, d)
    stats = profile.feature_statistics(long.where("idx <> 4")).select("idx", "mean", "std")
    return attach(long, stats, ["idx"], "left").select(
        "impression_id", "idx",
        F.round(features.zscore(F.col("value"), F.col("mean"), F.col("std")), 6).alias("value"),
    )


@check("dense_log2", "impressions", """
SELECT impression_id, show_pos AS v0, f1 AS v1, f3 AS v3, round(log2(f4 + 2) - 1, 6) AS v4 FROM impressions""")
def dense_log2(spark, d):
    dense = features.densify(features.parse_features(F.col("ltr_features")), F.col("show_pos"), 4)
    x = tables.impressions(spark, d).select("impression_id", features.dense_log2(dense).alias("v"))
    return x.select(
        "impression_id", F.get("v", 0).cast("int").alias("v0"), F.get("v", 1).alias("v1"), F.get("v", 3).alias("v3"),
        F.round(F.get("v", 4), 6).alias("v4"),
    )


@check("log1p", "clicks", "SELECT cid, round(ln(1 + dclk), 6) AS log_dclk FROM clicks")
def log1p(spark, d):
    return tables.clicks(spark, d).select("cid", F.round(F.log1p("dclk"), 6).alias("log_dclk"))


def sql_geohash(lat, lng, precision=6):
    """Interval halving written as scaled cells, a bit at a time."""
    n = 5 * precision // 2
    x, y = f"least(floor(({lng} + 180) / 360 * {1 << n}), {(1 << n) - 1})::BIGINT", f"least(floor(({lat} + 90) / 180 * {1 << n}), {(1 << n) - 1})::BIGINT"
    chars = []
    for k in range(precision):
        bits = []
        for b in range(5):
            j = 5 * k + b
            src = x if j % 2 == 0 else y
            bits.append(f"((({src}) >> {n - 1 - j // 2}) & 1) * {1 << (4 - b)}")
        chars.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} + 1 AS INT), 1)")
    return " || ".join(chars)


@check("geohash6", "places searchers", f"""
SELECT 'item' AS side, poi_id AS id, {sql_geohash('lat', 'lng')} AS geohash FROM places
UNION ALL SELECT 'query', uid, {sql_geohash('lat', 'lng')} FROM searchers
UNION ALL SELECT 'bad', poi_id, '[UNK]' FROM places""")
def geohash6(spark, d):
    places = tables.places(spark, d).select(F.lit("item").alias("side"), F.col("poi_id").alias("id"), "lat", "lng")
    users = tables.searchers(spark, d).select(F.lit("query").alias("side"), F.col("uid").alias("id"), "lat", "lng")
    bad = places.withColumns({
        "side": F.lit("bad"), "lat": F.when(F.pmod("id", F.lit(2)) == 0, F.col("lat") + 300),
    })
    both = places.unionByName(users).unionByName(bad)
    return both.select("side", "id", geo.geohash(F.col("lat"), F.col("lng")).alias("geohash"))


SQL_KM = """2 * 6371.0 * asin(least(sqrt(power(sin((radians(p.lat) - radians(s.lat)) / 2), 2)
  + cos(radians(s.lat)) * cos(radians(p.lat)) * power(sin((radians(p.lng) - radians(s.lng)) / 2), 2)), 1.0))"""


@check("haversine", "impressions places searchers", f"""
WITH k AS (SELECT impression_id, {SQL_KM} AS km FROM impressions i JOIN places p ON p.poi_id = i.poi_id JOIN searchers s ON s.uid = i.uid)
SELECT impression_id, round(km, 4) AS km, CAST(least(floor(log2(1 + km)), 15) AS INT) AS bucket FROM k""")
def haversine(spark, d):
    p = tables.places(spark, d).select("poi_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    s = tables.searchers(spark, d).select("uid", "lat", "lng")
    km = geo.haversine_km(F.col("lng"), F.col("lat"), F.col("p_lng"), F.col("p_lat"))
    rows = tables.impressions(spark, d).join(p, "poi_id").join(s, "uid").select("impression_id", km.alias("km"))
    return rows.select("impression_id", F.round("km", 4).alias("km"), geo.distance_bucket(F.col("km")).alias("bucket"))


@check("uid_bucket", "searchers", "SELECT uid, CAST(right(uid_text, 8) AS BIGINT) % 14138257 AS bucket FROM searchers")
def uid_bucket(spark, d):
    return tables.searchers(spark, d).select("uid", features.user_bucket(F.col("uid_text")).alias("bucket"))


@check("masked_statistics", "impressions", """
SELECT impression_id, 215 AS width, CAST(1.5 AS DOUBLE) AS distance, CASE WHEN show_pos > 0 THEN 1 ELSE 0 END AS has_score, show_pos AS score,
  CASE WHEN label = 2 THEN 1 ELSE 0 END AS text_recall, CASE WHEN query_type = 4 THEN 0 ELSE f1 END AS common_end,
  CASE WHEN query_type = 4 THEN f1 ELSE 0 END AS common_start, CASE WHEN query_type = 4 THEN 0 ELSE 41 * f4 END AS dest_geo,
  CASE WHEN query_type = 4 THEN 41 * f4 ELSE 0 END AS start_geo, 0 AS missing_group, CAST(0.25 AS DOUBLE) AS match_ratio FROM impressions""")
def masked_statistics(spark, d):
    # Type 0 is the start side in these records.
    f = features.parse_features(F.col("ltr_features"))
    im = tables.impressions(spark, d).withColumn("f", f)
    count, group = F.try_element_at("f", F.lit(1)), F.array_repeat(F.try_element_at("f", F.lit(4)), 41)
    stats = features.masked_statistics(
        F.when(F.col("query_type") == 4, "0").otherwise("1"), F.lit(1.5), F.col("show_pos"),
        F.when(F.col("label") == 2, "a,google_textsearch"),
        {k: count for k in ("common_end", "common_start", "person_end", "person_start", "common_total")},
        {"dest_query_city": F.lit(None).cast("array<double>"), "dest_pid_query_city": group,
         "dest_query_geohash": group, "start_query_geohash": group, "dest_pid_city": group},
        F.lit(0.25),
    )
    v = im.select("impression_id", stats.alias("v"))
    total = lambda start: F.round(F.aggregate(F.slice("v", start, 41), F.lit(0.0), lambda s, x: s + x), 6)
    return v.select(
        "impression_id", F.size("v").alias("width"), F.get("v", 0).alias("distance"),
        F.get("v", 1).cast("int").alias("has_score"), F.get("v", 2).cast("int").alias("score"),
        F.get("v", 3).cast("int").alias("text_recall"), F.get("v", 4).alias("common_end"), F.get("v", 5).alias("common_start"),
        total(10 + 82).alias("dest_geo"), total(10 + 123).alias("start_geo"), total(10).cast("int").alias("missing_group"),
        F.element_at("v", -1).alias("match_ratio"),
    )


@check("l2_normalize", "vectors", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x * (1 + city_id)) AS e FROM vectors),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM s)
SELECT vec_id, array_to_string(list_transform(e, lambda x: CAST(CAST(round(x / n * 1000000) AS BIGINT) AS STRING)), ',') AS unit FROM n""")
def l2_normalize(spark, d):
    stretched = F.transform("embedding", lambda x: x * (1 + F.col("city_id")))
    return tables.vectors(spark, d).select("vec_id", scaled(vectors.l2_normalise(stretched), 6).alias("unit"))


@check("cosine_pairs", "vectors", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine,
  round(list_inner_product(a.embedding, b.embedding), 6) AS inner_product
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    v = tables.vectors(spark, d)
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = v.join(following, "vec_id")
    return pairs.select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"),
        F.round(vectors.dot(F.col("embedding"), F.col("b")), 6).alias("inner_product"),
    )


@check("mean_pool", "vectors", """
WITH c AS (SELECT city_id, i, avg(embedding[i]) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
s AS (SELECT v.vec_id, c.i, sum(c.x) AS x FROM vectors v JOIN c ON c.city_id = v.city_id OR c.city_id = (v.city_id + 1) % 10 GROUP BY ALL)
SELECT v.vec_id, string_agg(CAST(CAST(round((v.embedding[s.i] + s.x) / 2 * 10000) AS BIGINT) AS STRING), ',' ORDER BY s.i) AS pooled
FROM vectors v JOIN s USING (vec_id) GROUP BY v.vec_id""")
def mean_pool(spark, d):
    # An item's two categories look up category vectors; the third slot is masked out.
    from rankspark.operators import pooling

    v = tables.vectors(spark, d)
    table = pooling.mean_vectors(v, "city_id", "embedding").withColumnRenamed("city_id", "field_id")
    city = F.col("city_id")
    items = v.select(
        "vec_id", "embedding", F.array(city, F.pmod(city + 1, F.lit(10)), F.pmod(city + 2, F.lit(10))).alias("ids"),
        F.array(F.lit(1), F.lit(1), F.lit(0)).alias("mask"),
    )
    pooled = pooling.pool_fields(items, "vec_id", "embedding", "ids", "mask", table)
    return pooled.select("vec_id", scaled("pooled", 4).alias("pooled"))


@check("position_weight", "impressions", """
WITH w AS (SELECT [-0.43, -0.234, -0.144, -0.117, -0.057, -0.042, 0.032, 0.022, 0.015, 0.01] AS w)
SELECT impression_id, round(CAST(w[CASE WHEN label = 0 THEN 9 ELSE least(show_pos + layer % 7, 9) END + 1] - w[4] AS DOUBLE), 6) AS reward FROM impressions, w""")
def position_weight(spark, d):
    rank = F.when(F.col("label") != 0, F.col("show_pos") + F.pmod("layer", F.lit(7)))
    return tables.impressions(spark, d).select(
        "impression_id", F.round(features.position_weight(rank), 6).alias("reward")
    )


@check("leaf_offsets", "impressions", """
SELECT impression_id, concat_ws(',', 4, 5, 66454 + show_pos, 66454 + 10 + layer % 5, 66454 + 15 + label, 0) AS tokens,
  '0,0,9,9,9,0' AS segments, '1,1,1,1,1,0' AS masks FROM impressions""")
def leaf_offsets(spark, d):
    leaves = F.array(F.col("show_pos"), F.pmod("layer", F.lit(5)), F.col("label"))
    numbers = lambda *xs: F.array(*[F.lit(x) for x in xs])
    text = F.struct(numbers(4, 5).alias("token_ids"), numbers(0, 0).alias("segment_ids"), numbers(1, 1).alias("mask_ids"))
    out = tokens.append_leaves(text, features.leaf_ids(leaves, features.leaf_offsets([10, 5, 3])), 6)
    return tables.impressions(spark, d).select("impression_id", out.alias("t")).select(
        "impression_id", ints("t.token_ids").alias("tokens"), ints("t.segment_ids").alias("segments"), ints("t.mask_ids").alias("masks"))


# ---------------------------------------------------------------- token sequences

# Vocabulary over item names and addresses; queries meet unknown words.
SQL_VOCAB = """
vocab AS (SELECT token, 5 + row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM (
  SELECT unnest(regexp_extract_all(lower(name_address), '([a-z]+|[0-9]+|[^a-z0-9 |])')) AS token FROM places) GROUP BY token)"""


def sql_ids(source: str, key: str, column: str, name: str) -> str:
    """Common table expression ``name``(key, ids) for a text column."""
    return f"""{name} AS (SELECT {key}, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM (
  SELECT {key}, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM (
    SELECT {key}, regexp_extract_all(lower({column}), '([a-z]+|[0-9]+|[^a-z0-9 |])') AS w FROM {source})) t
  LEFT JOIN vocab v ON v.token = t.token GROUP BY {key})"""


def sql_fit(ids: str, n: int) -> str:
    return f"array_to_string([coalesce(({ids})[i], 0) for i in range(1, {n} + 1)], ',')"


def vocabulary(spark, d):
    return encoding.build_vocabulary(tables.places(spark, d), "name_address")


@check("token_ids", "impressions places", f"""
WITH {SQL_VOCAB}, {sql_ids('impressions', 'impression_id', 'query', 'q')},
e AS (SELECT impression_id, [4] || ids[1:4] || [5] AS ids FROM q)
SELECT impression_id, {sql_fit('ids', 6)} AS token_ids, '0,0,0,0,0,0' AS segment_ids,
  array_to_string([CASE WHEN i <= len(ids) THEN 1 ELSE 0 END for i in range(1, 7)], ',') AS mask_ids FROM e""")
def token_ids(spark, d):
    rows = tables.impressions(spark, d).select("impression_id", "query")
    e = encoding.with_ids(rows, {"query": "ids"}, vocabulary(spark, d)).select(
        "impression_id", F.inline(F.array(tokens.encode(F.col("ids"), 6)))
    )
    return e.select("impression_id", *[ints(c).alias(c) for c in ("token_ids", "segment_ids", "mask_ids")])


@check("pair_segments", "places", f"""
WITH {SQL_VOCAB}, {sql_ids('places', 'poi_id', 'name', 'a')}, {sql_ids('places', 'poi_id', 'addr', 'b')},
e AS (SELECT poi_id, [4] || a.ids || [5] || b.ids || [5] AS ids, len(a.ids) + 2 AS n FROM a JOIN b USING (poi_id))
SELECT poi_id, {sql_fit('ids', 12)} AS token_ids,
  array_to_string([CASE WHEN i > n AND i <= len(ids) THEN 1 ELSE 0 END for i in range(1, 13)], ',') AS segment_ids,
  array_to_string([CASE WHEN i <= len(ids) THEN 1 ELSE 0 END for i in range(1, 13)], ',') AS mask_ids FROM e""")
def pair_segments(spark, d):
    p = tables.places(spark, d).select("poi_id", "name", "addr")
    p = encoding.with_ids(p, {"name": "a", "addr": "b"}, vocabulary(spark, d))
    sep = F.array(F.lit(tokens.SEP))
    ids = F.concat(F.array(F.lit(tokens.CLS)), "a", sep, "b", sep)
    e = p.select("poi_id", F.inline(F.array(tokens.pair_segments(ids, 12))))
    return e.select("poi_id", *[ints(c).alias(c) for c in ("token_ids", "segment_ids", "mask_ids")])


@check("truncate_pair", "", """
WITH s AS (SELECT doc_id, len(string_split(text, ' ')) AS a, len(string_split(text, chr(10))) AS b FROM documents),
k AS (SELECT doc_id, a, b, CASE WHEN a + b <= 61 THEN a WHEN a <= 31 THEN a WHEN b <= 30 THEN 61 - b ELSE 31 END AS ka FROM s)
SELECT doc_id, ka AS n_a, CASE WHEN a + b <= 61 THEN b ELSE 61 - ka END AS n_b FROM k""")
def truncate_pair(spark, d):
    words, lines = F.split("text", " "), F.split("text", "\n")
    a, b = tokens.truncate_pair(F.col("a"), F.col("b"), 61)
    return tables.texts(spark, d).select("doc_id", words.alias("a"), lines.alias("b")).select(
        "doc_id", F.size(a).alias("n_a"), F.size(b).alias("n_b")
    )


@check("append_feature_tokens", "impressions", """
SELECT impression_id, concat_ws(',', 4, label + 10, 5, city_id, 5, layer, 5, 0) AS token_ids, '0,0,0,2,2,3,3,0' AS segment_ids, '1,1,1,1,1,1,1,0' AS mask_ids FROM impressions""")
def append_feature_tokens(spark, d):
    base = tokens.encode(F.array(F.col("label") + 10), 3)
    ids = F.array(F.col("city_id"), F.lit(5), F.col("layer"), F.lit(5))
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    im = tables.impressions(spark, d).select("impression_id", base.alias("e"), ids.alias("ids"))
    out = tokens.append_features(F.col("e"), F.col("ids"), lit(2, 2, 3, 3), lit(1, 1, 1, 1), 8)
    return im.select("impression_id", F.inline(F.array(out))).select(
        "impression_id", *[ints(c).alias(c) for c in ("token_ids", "segment_ids", "mask_ids")]
    )


@check("append_alias", "places", """
WITH w AS (SELECT *, string_split(lower(category || ' ' || name || ' ' || addr), ' ') AS ac, greatest(6 - len(string_split(name, ' ')) - len(string_split(addr, ' ')), 0) AS room FROM places)
SELECT poi_id, name || '|' || addr || ' ' || array_to_string(ac[1:room], ' ') AS line FROM w""")
def append_alias(spark, d):
    alias = F.lower(F.concat_ws(" ", "category", "name", "addr"))
    return tables.places(spark, d).select(
        "poi_id", tokens.append_alias(F.col("name"), F.col("addr"), alias, budget=6).alias("line")
    )


@check("pad_categories", "places", """
WITH c AS (SELECT poi_id, list_transform(range(0, poi_id % 7), lambda x: x + city_id) AS c FROM places)
SELECT poi_id, array_to_string([coalesce(c[i], 0) for i in range(1, 5)], ',') AS ids,
  array_to_string([CASE WHEN i <= len(c) THEN 1 ELSE 0 END for i in range(1, 5)], ',') AS mask FROM c""")
def pad_categories(spark, d):
    n = F.pmod("poi_id", F.lit(7)).cast("int")
    cats = F.slice(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: x + F.col("city_id")), F.lit(1), n)
    ids, mask = tokens.pad_categories(F.col("c"))
    return tables.places(spark, d).select("poi_id", cats.alias("c")).select("poi_id", ints(ids).alias("ids"), ints(mask).alias("mask"))


@check("triple_token_ids", "impressions places", f"""
WITH {SQL_VOCAB}, p AS (SELECT impression_id, query, split_part(name_address, '|', 1) AS nm, split_part(name_address, '|', 2) AS ad FROM impressions),
{sql_ids('p', 'impression_id', 'query', 'q')}, {sql_ids('p', 'impression_id', 'nm', 'n')}, {sql_ids('p', 'impression_id', 'ad', 'a')},
r AS (SELECT impression_id, q.ids[1:6] AS q, n.ids[1:6 - least(len(q.ids), 6)] AS n, a.ids[1:6 - least(len(q.ids), 6) - least(len(n.ids), 6 - least(len(q.ids), 6))] AS a
  FROM q JOIN n USING (impression_id) JOIN a USING (impression_id)),
e AS (SELECT impression_id, [4] || q || [5] || n || [5] || a || [5] AS ids, len(q) + 2 AS k FROM r)
SELECT impression_id, {sql_fit('ids', 10)} AS token_ids,
  array_to_string([CASE WHEN i > k AND i <= len(ids) THEN 1 ELSE 0 END for i in range(1, 11)], ',') AS segment_ids FROM e""")
def triple_token_ids(spark, d):
    parts = F.split("name_address", r"\|")
    rows = tables.impressions(spark, d).select(
        "impression_id", "query", F.get(parts, 0).alias("name"), F.get(parts, 1).alias("addr")
    )
    rows = encoding.with_ids(rows, {"query": "q", "name": "n", "addr": "a"}, vocabulary(spark, d))
    e = rows.select("impression_id", F.inline(F.array(tokens.encode_triple(F.col("q"), F.col("n"), F.col("a"), 10))))
    return e.select("impression_id", ints("token_ids").alias("token_ids"), ints("segment_ids").alias("segment_ids"))


@check("multi_value_ids", "places", """
WITH w AS (SELECT poi_id, string_split(name_address, ' ') AS w FROM places),
t AS (SELECT poi_id, unnest(w) AS value, unnest(range(1, len(w) + 1)) AS pos FROM w),
c AS (SELECT value, count(*) AS cnt FROM t GROUP BY value HAVING count(*) > 20
  UNION ALL SELECT 'UNK', (SELECT count(*) FROM places)),
dict AS (SELECT value, row_number() OVER (ORDER BY cnt DESC, value) AS id FROM c),
l AS (SELECT poi_id, list(coalesce(dict.id, (SELECT id FROM dict WHERE value = 'UNK')) ORDER BY pos) AS ids FROM t LEFT JOIN dict USING (value) GROUP BY poi_id)
SELECT poi_id, array_to_string([coalesce(ids[i], 0) for i in range(1, 11)], ',') AS ids FROM l""")
def multi_value_ids(spark, d):
    p = tables.places(spark, d).select("poi_id", F.split("name_address", " ").alias("terms"))
    counts = dictionary.value_counts(p, {"terms": [F.col("terms")]})
    counts = dictionary.filter_by_count(counts, {"terms": 20}).unionByName(dictionary.unknown_rows(p, ["terms"]))
    ids = dictionary.number(counts)
    out = encoding.multi_value_ids(p, "poi_id", F.col("terms"), "terms", ids, 10, "ids")
    return out.select("poi_id", ints("ids").alias("ids"))
