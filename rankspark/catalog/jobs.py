"""Checks of the sample-building jobs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rankspark.catalog.joins import SQL_LAST, SQL_TAKEN, item_index
from rankspark.catalog.models import _trees
from rankspark.catalog.numbers import SQL_KM, SQL_VOCAB, sql_fit, sql_geohash, sql_ids, vocabulary
from rankspark.catalog.records import SQL_NAME
from rankspark.catalog.registry import check, ints, scaled, scaled_text
from rankspark.catalog.texts import sql_normalise
from rankspark.functions import calendar, features, geo, text, tokens
from rankspark.operators import dictionary, encoding, groups, profile, records, similarity
from rankspark.plans import jobs
from rankspark.session import freed_shuffles, kept, materialise, new_path, scratch
from rankspark.sources import files, logs, tables


def _lines(spark, df, *columns):
    path = new_path(spark, "lines")
    with freed_shuffles(spark):
        files.write_lines(df, path, *columns, compression="gzip")
    return files.scan_text(spark, path)


def shown(columns):
    return [ints(c).alias(c) for c in columns]


@check("job_parse_log", "impressions", f"""
WITH s AS (SELECT search_uid, date_trunc('month', min(dt)) AS m FROM impressions GROUP BY search_uid)
SELECT search_uid, impression_id, count(*) OVER (PARTITION BY search_uid) AS group_len, label, show_pos, {SQL_NAME} AS name_address, f1, f2, f3, f4
FROM impressions JOIN s USING (search_uid) WHERE label >= 1 AND country_code = 'AMERICA' AND m BETWEEN DATE '1993-01-01' AND DATE '1998-06-01'""")
def job_parse_log(spark, d):
    path = new_path(spark, "log")
    logs.write_log(tables.search_log(spark, d), path)
    samples = records.samples(logs.scan_log(spark, path, "1993-01-01", "1998-06-01", "AMERICA"))
    return samples.select(
        "search_uid", F.col("p_impression_id").alias("impression_id"), F.col("group_len").cast("bigint").alias("group_len"),
        "label", F.col("p_show_pos").alias("show_pos"), F.col("p_name_address").alias("name_address"),
        *[F.try_element_at("features", F.lit(i)).alias(f"f{i}") for i in range(1, 5)],
    )


def _located(spark, d):
    """Impressions with name, address, features, both coordinates and their geohashes."""
    name, addr = jobs.name_and_address()
    cell = geo.geohash(F.col("lat"), F.col("lng"))
    p = tables.places(spark, d).select("poi_id", F.col("lat").alias("item_lat"), F.col("lng").alias("item_lng"), cell.alias("geo"))
    s = tables.searchers(spark, d).select("uid", "lat", "lng", cell.alias("q_geo"))
    return (
        tables.impressions(spark, d, p, s)
        .withColumns({"name": name, "addr": addr, "f": features.parse_features(F.col("ltr_features"))})
    )


def _feature(i):
    return F.try_element_at("f", F.lit(i))


@check("job_gbdt_samples", "impressions places searchers", f"""
WITH p AS (SELECT *, split_part(name_address, '|', 1) AS nm, split_part(name_address, '|', 2) AS ad FROM impressions
  QUALIFY row_number() OVER (PARTITION BY search_uid, poi_id ORDER BY show_pos, impression_id) = 1),
k AS (SELECT i.*, {SQL_KM} AS km FROM p i JOIN places p ON p.poi_id = i.poi_id JOIN searchers s ON s.uid = i.uid)
SELECT impression_id, count(*) OVER (PARTITION BY search_uid) AS group_len, label, 244 AS width,
  round(1 - levenshtein(query, nm) / greatest(length(query), length(nm)), 6) AS edit_name,
  round(1 - levenshtein(query, ad) / greatest(length(query), length(ad)), 6) AS edit_addr,
  length(query) AS query_len, CASE WHEN query_type = 1 THEN 1 ELSE 0 END AS is_end, round(km, 4) AS km,
  round(km, 4) AS distance, CASE WHEN show_pos > 0 THEN 1 ELSE 0 END AS has_score, show_pos AS score, CASE WHEN label = 2 THEN 1 ELSE 0 END AS text_recall,
  f1 AS common_end, CAST(0 AS DOUBLE) AS common_start, f3 AS person_end, CAST(0 AS DOUBLE) AS person_start, layer AS total,
  0 AS query_city, round(41 * f1, 4) AS pid_query_city, round(41 * f2, 4) AS dest_geohash, 0 AS start_geohash, round(41 * f4, 4) AS pid_city FROM k""")
def job_gbdt_samples(spark, d):
    order = [F.col("show_pos"), F.col("impression_id")]
    located = _located(spark, d).select(
        "search_uid", "impression_id", "poi_id", "show_pos", "label", "layer", "query_type", "query", "name", "addr",
        "lat", "lng", "item_lat", "item_lng", "f")
    with scratch(spark):
        samples = jobs.gbdt_samples(located, "search_uid", "poi_id", order)
        with kept():
            rows = materialise(samples, "samples")
    places = tables.places(spark, d)
    out = jobs.similarity_samples(
        rows, rows.select(F.col("query").alias("text")).distinct(),
        places.select(F.col("name").alias("text")), places.select(F.col("addr").alias("text")),
        {"common_end": _feature(1), "common_start": _feature(2), "person_end": _feature(3), "person_start": _feature(4), "common_total": F.col("layer")},
        {"dest_pid_query_city": F.array_repeat(_feature(1), 41), "dest_query_geohash": F.array_repeat(_feature(2), 41),
         "start_query_geohash": F.array_repeat(_feature(3), 41), "dest_pid_city": F.array_repeat(_feature(4), 41)},
        F.col("show_pos"), F.when(F.col("label") == 2, "a,google_textsearch"),
    )
    at = lambda i: F.get("dense", F.lit(i))
    whole = lambda i: F.round(F.aggregate(F.slice("dense", i + 1, 41), F.lit(0.0), lambda s, x: s + x), 4)
    return out.select(
        "impression_id", "group_len", "label", F.size("dense").alias("width"), F.round(at(15), 6).alias("edit_name"),
        F.round(at(16), 6).alias("edit_addr"), at(20).cast("int").alias("query_len"), at(24).cast("int").alias("is_end"),
        F.round(at(26), 4).alias("km"), F.round(at(29), 4).alias("distance"), at(30).cast("int").alias("has_score"),
        at(31).cast("int").alias("score"), at(32).cast("int").alias("text_recall"), at(33).alias("common_end"),
        at(34).alias("common_start"), at(35).alias("person_end"), at(36).alias("person_start"), at(37).cast("int").alias("total"),
        whole(38).cast("int").alias("query_city"), whole(79).alias("pid_query_city"), whole(120).alias("dest_geohash"),
        whole(161).cast("int").alias("start_geohash"), whole(202).alias("pid_city"),
    )


def _pair_job(spark, d, keep=(), prepare=lambda df: df, trees=True):
    with scratch(spark):
        return _pairs_of_rows(spark, d, keep, prepare, trees)


def _pairs_of_rows(spark, d, keep, prepare, trees):
    # Counts, statistics, trees and pairs all pass over the rows, so they are joined and parsed once.
    f = features.parse_features(F.col("ltr_features"))
    rows = materialise(tables.impressions(spark, d).select(
        "search_uid", "impression_id", "uid", "poi_id", "layer", "query", "name_address", "label", "show_pos", f.alias("f")),
        "typed", "snappy")
    counts = dictionary.value_counts(
        rows, {"uid": [F.col("uid")], "poiid": [F.col("poi_id")], "layer": [F.col("layer")]}
    )
    ids = dictionary.number(counts.unionByName(dictionary.unknown_rows(rows, ["uid", "poiid", "layer"])))
    if trees:
        rows = rows.withColumn("features", array_to_vector(F.array(*[features.slot_of(F.col("f"), F.lit(0), i) for i in range(1, 5)])))
    model = _trees(rows.withColumn("label", (F.col("label") == 2).cast("double")), trees=3) if trees else None
    long = rows.select(F.explode("f").alias("idx", "value"))
    stats = profile.feature_statistics(long).join(profile.group_medians(long, "idx", "value"), "idx")
    # One row per feature index: a fixed number.
    table = {r.idx: (r.median, r.low) for r in stats.collect()}
    fields = {"uid_id": ("uid", "uid"), "poi_idx": ("poi_id", "poiid"), "layer_id": ("layer", "layer")}
    ready = prepare(rows)
    with kept():
        return jobs.pair_samples(ready, "search_uid", ids, fields, model, table, keep)


@check("job_pair_samples")
def job_pair_samples(spark, d):
    out = _pair_job(spark, d)
    return out.select(
        "search_uid", "impression_id", "uid_id", "poi_idx", "pos_poi_idx", "pos_label", "label",
        *shown(["leaves", "pos_leaves"]), F.round("tree_score", 6).alias("tree_score"), F.size("scaled").alias("n_scaled"),
    )


def _with_tokens(spark, d):
    """Adds the shown token ids of written rows, made once for each distinct pair of texts."""
    def lists(texts):
        coded = encoding.with_ids(texts, {"query": "_q", "name_address": "_n"}, vocabulary(spark, d))
        return coded.select("query", "name_address", ints(tokens.encode_pair(F.col("_q"), F.col("_n"), 60).token_ids).alias("token_ids"))

    return lambda rows: similarity.per_texts(rows, ["query", "name_address"], lists)


SQL_PAIR_KEYS = {"uid_id": ("uid", "uid"), "poi_idx": ("poiid", "poi_id"), "layer_id": ("layer", "layer")}
SQL_SCALED = "CASE WHEN f{i} - lo{i} <= 0 OR md{i} - lo{i} <= 0 THEN 0 ELSE ln((1 + f{i} - lo{i}) / (1 + md{i} - lo{i})) END"


@check("job_pair_columns", "impressions places", f"""
WITH {SQL_VOCAB}, {sql_ids('impressions', 'impression_id', 'query', 'q')}, {sql_ids('impressions', 'impression_id', 'name_address', 'n')},
st AS (SELECT {', '.join(f'median(f{i}) AS md{i}, min(f{i}) AS lo{i}' for i in range(1, 5))} FROM impressions),
dict AS (SELECT dict_key, value, CAST(row_number() OVER (PARTITION BY dict_key ORDER BY cnt DESC, value) AS INT) AS idx FROM (
  {' UNION ALL '.join(f"SELECT '{k}' AS dict_key, CAST({c} AS STRING) AS value, count(*) AS cnt FROM impressions GROUP BY {c}" for k, c in SQL_PAIR_KEYS.values())}
  UNION ALL SELECT unnest(['uid', 'poiid', 'layer']), 'UNK', (SELECT count(*) FROM impressions))),
e AS (SELECT i.search_uid, i.impression_id, label, {', '.join(f'd_{n}.idx AS {n}' for n in SQL_PAIR_KEYS)},
  concat_ws(',', {', '.join(f"CAST(round(round({SQL_SCALED.format(i=i)}, 4) * 10000) AS BIGINT)" for i in range(1, 5))}) AS scaled,
  {sql_fit('[4] || q.ids || [5] || n.ids || [5]', 60)} AS token_ids,
  row_number() OVER (PARTITION BY search_uid ORDER BY label DESC, show_pos, i.impression_id) AS place
  FROM impressions i JOIN q ON q.impression_id = i.impression_id JOIN n ON n.impression_id = i.impression_id
  {' '.join(f"JOIN dict d_{n} ON d_{n}.dict_key = '{k}' AND d_{n}.value = CAST(i.{c} AS STRING)" for n, (k, c) in SQL_PAIR_KEYS.items())}, st)
SELECT a.search_uid, a.impression_id, {', '.join(f"a.{c}, t.{c} AS pos_{c}" for c in ['label', *SQL_PAIR_KEYS, 'scaled', 'token_ids'])}
FROM e a JOIN e t ON t.search_uid = a.search_uid AND t.place = 1""")
def job_pair_columns(spark, d):
    """What the pair jobs hold without a model, tokens included."""
    out = _pair_job(spark, d, ["token_ids"], _with_tokens(spark, d), trees=False)
    both = lambda c: (c, f"pos_{c}")
    return out.select(
        "search_uid", "impression_id", *both("label"), *[c for n in SQL_PAIR_KEYS for c in both(n)],
        *[scaled(c).alias(c) for c in both("scaled")], *both("token_ids"))


@check("job_token_pair_samples")
def job_token_pair_samples(spark, d):
    out = _pair_job(spark, d, ["token_ids"], _with_tokens(spark, d))
    return out.select(
        "search_uid", "impression_id", "poi_idx", "pos_poi_idx", "token_ids", "pos_token_ids",
        F.round("tree_score", 6).alias("tree_score"),
    )


@check("job_poi_tokens", "places", f"""
WITH {SQL_VOCAB}, x AS (SELECT *, lower(category) || ' ' || name AS ac FROM places),
y AS (SELECT *, addr || ' ' || array_to_string(string_split(ac, ' ')[1:32 - len(string_split(name, ' ')) - len(string_split(addr, ' '))], ' ') AS second FROM x),
{sql_ids('y', 'poi_id', 'name', 'a')}, {sql_ids('y', 'poi_id', 'second', 'b')},
e AS (SELECT poi_id, [4] || a.ids || [5] || b.ids || [5] AS ids FROM a JOIN b USING (poi_id))
SELECT poi_id, CAST(city_id AS STRING) AS city, {sql_fit('ids', 32)} AS poi_token_ids, city_id AS area_id, layer AS geocode_id, CAST(layer AS DOUBLE) / 4 AS click_score,
  concat_ws(',', layer, city_id, 0, 0) AS category_ids, '1,1,0,0' AS category_mask FROM y JOIN e USING (poi_id)""")
def job_poi_tokens(spark, d):
    p = tables.places(spark, d)
    line = F.concat_ws(
        "||", "poi_id", "name", "addr", "lng", "lat", "city_id", F.lit("55"), "city_id", "layer",
        (F.col("layer") / 4).cast("string"), F.concat_ws("#", "layer", "city_id"), F.lit("MX"),
        F.concat_ws(" ", F.lower("category"), "name"),
    )
    out = jobs.poi_tokens(_lines(spark, p, line), vocabulary(spark, d))
    lists = ("poi_token_ids", "category_ids", "category_mask")
    return out.select(*[c for c in out.columns if c not in lists], *shown(lists))


def _query_lines(spark, d, extra=False):
    im = tables.impressions(spark, d).where("label = 2")
    fields = [
        "search_id", "country_code", "city_id", "poi_id", "query", "name_address", F.lit(""), F.lit("0"), "impression_id",
        F.when(F.col("layer") > 25, "origin").otherwise("deep_correct"), F.lit("q"),
    ]
    if extra:
        fields += ["query_type", "city_id", "layer", F.dayofweek("dt").cast("string"), F.floor(F.pmod("search_id", F.lit(24)) / 4).cast("string")]
    text = [F.col(c).cast("string") if isinstance(c, str) else c for c in fields]
    return _lines(spark, im, F.lit("key"), F.concat_ws("##", *text))


SQL_QUERY_ITEMS = f"""
x AS (SELECT *, split_part(name_address, '|', 1) AS nm, split_part(name_address, '|', 2) AS ad FROM impressions WHERE label = 2),
{sql_ids('x', 'impression_id', 'query', 'q')}, {sql_ids('x', 'impression_id', 'nm', 'a')}, {sql_ids('x', 'impression_id', 'ad', 'b')},
idx AS (SELECT poi_id, row_number() OVER (ORDER BY poi_id) - 1 AS idx FROM places),
t AS (SELECT x.*, idx.idx, [4] || q.ids || [5] AS qt, [4] || a.ids || [5] || b.ids || [5] AS pt
  FROM x JOIN q USING (impression_id) JOIN a USING (impression_id) JOIN b USING (impression_id) JOIN idx USING (poi_id))"""


@check("job_query_rows", "impressions places", f"""
WITH {SQL_VOCAB}, {SQL_QUERY_ITEMS}
SELECT impression_id AS uniq_id, poi_id, city_id, idx, {sql_fit('qt', 32)} AS query_token_ids, {sql_fit('pt', 32)} AS poi_token_ids FROM t WHERE length(query) >= 15""")
def job_query_rows(spark, d):
    idx = item_index(tables.places(spark, d))
    out = jobs.query_rows(_query_lines(spark, d), vocabulary(spark, d), idx)
    return out.select("uniq_id", "poi_id", "city_id", "idx", *shown(["query_token_ids", "poi_token_ids"]))


@check("job_multifeature_rows", "impressions places", f"""
WITH {SQL_VOCAB}, {SQL_QUERY_ITEMS},
m AS (SELECT impression_id AS uniq_id, idx, query_type, city_id AS area_id, layer AS geohash_id, dayofweek(dt) + 1 AS week_bucket,
  CAST(floor((search_id % 24) / 4) AS INT) AS day_bucket, {sql_fit('pt', 32)} AS poi_token_ids, city_id, layer FROM t)
SELECT 'train' AS part, * EXCLUDE (city_id, layer) FROM m UNION ALL SELECT 'test', * EXCLUDE (city_id, layer) FROM m WHERE city_id = 7 AND layer > 25""")
def job_multifeature_rows(spark, d):
    idx = item_index(tables.places(spark, d))
    lines, vocab = _query_lines(spark, d, extra=True), vocabulary(spark, d)
    show = lambda df, part: df.select(
        F.lit(part).alias("part"), "uniq_id", "idx", *jobs.EXTRA_COLUMNS, *shown(["poi_token_ids"])
    )
    train, test = (jobs.multifeature_rows(lines, vocab, idx, city) for city in (None, "7"))
    return show(train, "train").unionByName(show(test, "test"))


@check("job_labelled_pairs", "impressions places", f"""
WITH {SQL_VOCAB}, x AS (SELECT *, split_part(name_address, '|', 1) AS nm, split_part(name_address, '|', 2) AS ad FROM impressions),
{sql_ids('x', 'impression_id', 'query', 'q')}, {sql_ids('x', 'impression_id', 'nm', 'a')}, {sql_ids('x', 'impression_id', 'ad', 'b')}
SELECT search_id AS query_idx, poi_id AS poi_idx, {sql_fit('[4] || q.ids || [5]', 32)} AS query_token_ids,
  {sql_fit('[4] || a.ids || [5] || b.ids || [5]', 32)} AS poi_token_ids, least(label, 1) AS label, CASE WHEN label = 2 THEN 1 ELSE 0 END AS origin_label
FROM x JOIN q USING (impression_id) JOIN a USING (impression_id) JOIN b USING (impression_id)""")
def job_labelled_pairs(spark, d):
    kind = F.when(F.col("label") == 2, "positive").when(F.col("label") == 1, "hard_negative").otherwise("negative")
    im = tables.impressions(spark, d)
    lines = _lines(
        spark, im, F.col("search_id").cast("string"), "query", F.lit("p"), F.col("poi_id").cast("string"), "name_address", kind
    )
    out = jobs.labelled_pairs(lines, vocabulary(spark, d))
    return out.select("query_idx", "poi_idx", "label", "origin_label", *shown(["query_token_ids", "poi_token_ids"]))


SQL_TRIPLE = f"""
x AS (SELECT impression_id, query, pos_name, name_address AS neg_name FROM impressions JOIN last USING (search_uid) WHERE label <> 2)"""


@check("job_triplets", "impressions places", f"""
WITH {SQL_VOCAB}, {SQL_LAST}, {SQL_TRIPLE}, s AS (SELECT *, split_part(pos_name, '|', 1) AS pn, split_part(pos_name, '|', 2) AS pa,
  split_part(neg_name, '|', 1) AS nn, split_part(neg_name, '|', 2) AS na FROM x),
{sql_ids('s', 'impression_id', 'query', 'q')}, {sql_ids('s', 'impression_id', 'pn', 'a')}, {sql_ids('s', 'impression_id', 'pa', 'b')},
{sql_ids('s', 'impression_id', 'nn', 'c')}, {sql_ids('s', 'impression_id', 'na', 'e')}
SELECT {sql_fit('[4] || q.ids || [5]', 32)} AS query_token_ids, {sql_fit('[4] || a.ids || [5] || b.ids || [5]', 32)} AS pos_token_ids,
  {sql_fit('[4] || c.ids || [5] || e.ids || [5]', 32)} AS neg_token_ids, 1 AS label
FROM q JOIN a USING (impression_id) JOIN b USING (impression_id) JOIN c USING (impression_id) JOIN e USING (impression_id)""")
def job_triplets(spark, d):
    from rankspark.operators import pairs

    p = pairs.clicked_against_rest(tables.impressions(spark, d), "search_uid", ["name_address"])
    lines = _lines(spark, p, "query", "pos_name_address", "name_address")
    out = jobs.triplets(lines, vocabulary(spark, d))
    return out.select("label", *shown(["query_token_ids", "pos_token_ids", "neg_token_ids"]))


@check("job_group_triplets", "impressions places", f"""
WITH {SQL_VOCAB}, {SQL_LAST}, {SQL_TRIPLE},
{sql_ids('x', 'impression_id', 'query', 'q')}, {sql_ids('x', 'impression_id', 'pos_name', 'a')}, {sql_ids('x', 'impression_id', 'neg_name', 'b')}
SELECT impression_id, {sql_fit('[4] || q.ids || [5] || a.ids || [5]', 64)} AS pos_token_ids,
  {sql_fit('[4] || q.ids || [5] || b.ids || [5]', 64)} AS neg_token_ids, 1 AS label FROM q JOIN a USING (impression_id) JOIN b USING (impression_id)""")
def job_group_triplets(spark, d):
    out = jobs.group_triplets(tables.impressions(spark, d), "search_uid", "impression_id", vocabulary(spark, d))
    return out.select("impression_id", "label", *shown(["pos_token_ids", "neg_token_ids"]))


def _rank_sql():
    """The whole job in plain SQL."""
    keys = {"uid": ["uid"], "geo": ["q_geo", "geo"], "poiid": ["poi_id"], "cate": ["category"], "layer": ["layer"]}
    counted = " UNION ALL ".join(
        f"SELECT '{k}' AS dict_key, v AS value, count(*) AS cnt FROM (SELECT unnest([{', '.join(f'CAST({c} AS STRING)' for c in cs)}]) AS v FROM ir) GROUP BY v"
        for k, cs in keys.items())
    fixed = "SELECT 'qtype', unnest(['0', '1']), (SELECT count(*) FROM ir) UNION ALL SELECT 'hour', unnest(['0', '1', '2']), (SELECT count(*) FROM ir)"
    idx = lambda key, value: f"(SELECT idx FROM dict WHERE dict_key = '{key}' AND value = {value})"
    padded = lambda ids, n: f"[coalesce(({ids})[i], 0) for i in range(1, {n} + 1)]"
    text_of = lambda ids, n: f"array_to_string({padded(ids, n)}, ',')"
    query_part = "[CAST(q_geo_id AS BIGINT), 5, side_id, 5, hour_id, 5]"
    item_part = "[CAST(geo_id AS BIGINT), 5, category_id, 5, layer_id, 5]"
    return f"""
WITH {SQL_VOCAB}, ir AS (SELECT i.*, {sql_geohash('s.lat', 's.lng')} AS q_geo, {sql_geohash('p.lat', 'p.lng')} AS geo, {SQL_KM} AS km,
  row_number() OVER (PARTITION BY search_uid ORDER BY show_pos, impression_id) - 1 AS listed,
  split_part(i.name_address, '|', 1) AS nm, split_part(i.name_address, '|', 2) AS ad
  FROM impressions i JOIN places p ON p.poi_id = i.poi_id JOIN searchers s ON s.uid = i.uid),
h AS (SELECT search_uid, query AS h_query FROM ir WHERE listed = 0),
dict AS (SELECT dict_key, value, row_number() OVER (PARTITION BY dict_key ORDER BY cnt DESC, value) AS idx FROM (
  {counted} UNION ALL {fixed} UNION ALL SELECT unnest(['uid', 'geo', 'poiid', 'cate', 'layer', 'qtype', 'hour']), 'UNK', (SELECT count(*) FROM ir))),
{sql_ids('h', 'search_uid', 'h_query', 'q')}, {sql_ids('ir', 'impression_id', 'nm', 'n')}, {sql_ids('ir', 'impression_id', 'ad', 'a')},
e AS (SELECT ir.search_uid, h_query, label, ir.poi_id, listed, CASE WHEN label = 0 THEN -1 ELSE show_pos END AS shown, ir.search_uid || '-' || listed AS imp,
  CAST(least(floor(log2(1 + km)), 15) AS BIGINT) AS distance_id, du.idx AS uid_id, dq.idx AS q_geo_id, dg.idx AS geo_id, dc.idx AS category_id, dl.idx AS layer_id,
  {idx('qtype', "'1'")} AS side_id,
  CASE WHEN search_id % 24 BETWEEN 6 AND 11 THEN {idx('hour', "'0'")} WHEN search_id % 24 BETWEEN 12 AND 17 THEN {idx('hour', "'1'")} ELSE {idx('hour', "'2'")} END AS hour_id,
  q.ids AS qi, n.ids AS ni, a.ids AS ai,
  least(len(list_intersect(string_split(h_query, ' '), string_split(replace(name_address, '|', ' '), ' '))), 20) AS n_match
  FROM ir JOIN h ON h.search_uid = ir.search_uid JOIN q ON q.search_uid = ir.search_uid
  JOIN n ON n.impression_id = ir.impression_id JOIN a ON a.impression_id = ir.impression_id
  JOIN dict du ON du.dict_key = 'uid' AND du.value = CAST(uid AS STRING) JOIN dict dq ON dq.dict_key = 'geo' AND dq.value = q_geo
  JOIN dict dg ON dg.dict_key = 'geo' AND dg.value = geo JOIN dict dc ON dc.dict_key = 'cate' AND dc.value = category
  JOIN dict dl ON dl.dict_key = 'layer' AND dl.value = CAST(layer AS STRING)),
f AS (SELECT *, {text_of(f"{padded('[4] || qi[1:30] || [5]', 32)} || {query_part}", 44)} AS query_token_ids,
  {text_of(f"{padded('[4] || ni || [5] || ai || [5]', 32)} || [0, 0, 0, 0, 0, 0] || {item_part}", 44)} AS poi_token_ids,
  {text_of(f"{padded('[4] || qi || [5] || ni || [5] || ai || [5]', 32)} || {query_part} || {item_part} || [distance_id, 5]", 46)} AS cross_token_ids FROM e),
last AS (SELECT search_uid, max_by(imp, (shown, imp)) AS pos_imp FROM f WHERE label = 2 GROUP BY search_uid)
SELECT f.h_query AS query, CAST(f.uid_id AS INT) AS uid_id, CASE WHEN f.imp = pos_imp THEN 1 WHEN f.shown <> -1 THEN 0 ELSE 2 END AS part,
  CASE WHEN f.label = 2 OR f.listed < 3 THEN 1 ELSE 0 END AS new_label, CAST(f.poi_id AS STRING) AS poi_id, CAST(p.poi_id AS STRING) AS pos_poi_id,
  f.n_match, f.distance_id, f.query_token_ids, f.poi_token_ids, f.cross_token_ids, p.cross_token_ids AS pos_cross_token_ids
FROM f JOIN last ON last.search_uid = f.search_uid JOIN f p ON p.search_uid = f.search_uid AND p.imp = pos_imp WHERE f.imp = pos_imp OR f.label <> 2"""


@check("job_rank_rows", "impressions places searchers", _rank_sql())
def job_rank_rows(spark, d):
    with scratch(spark):
        lines, ids = _rank_lines(spark, d)
    out = jobs.rank_rows(lines, vocabulary(spark, d), ids)
    return out.select(
        "query", "uid_id", "part", "new_label", "poi_id", "pos_poi_id", "n_match", "distance_id",
        *shown(["query_token_ids", "poi_token_ids", "cross_token_ids", "pos_cross_token_ids"]),
    )


def _rank_lines(spark, d):
    """Rank lines and the dictionary of their values; these two are kept."""
    # Five passes over the rows follow.
    rows = materialise(_located(spark, d).select(
        "search_uid", "impression_id", "label", "show_pos", "poi_id", "name_address", "item_lat", "item_lng", "category", "layer", "geo",
        "city_id", "query", "uid", "lat", "lng", "time_text", "query_type", "q_geo"), "located")
    item = F.concat_ws(
        "##", F.col("label").cast("string"), F.when(F.col("label") == 0, "-1").otherwise(F.col("show_pos").cast("string")),
        "poi_id", "name_address", "item_lat", "item_lng", "category", "layer", "geo",
    )
    head = ["city_id", "query", "uid", "lat", "lng", "time_text", "query_type", "q_geo"]
    searches = groups.first_by(rows, "search_uid", F.struct(*head), F.struct("show_pos", "impression_id"), "h")
    listed = rows.select("search_uid", "show_pos", "impression_id", item.alias("item"))
    lists = groups.gather(listed, ["search_uid"], [F.col("show_pos"), F.col("impression_id")], F.col("item"))
    with kept():
        lines = _lines(
            spark, lists.join(searches, "search_uid"), F.col("h.city_id").cast("string"), "h.query", F.col("h.uid").cast("string"),
            F.concat_ws("|", "h.lat", "h.lng"), "h.time_text", F.col("h.query_type").cast("string"), "h.q_geo", F.array_join("items", "||"),
            "search_uid", F.col("page").cast("string"),
        )
    keys = {"uid": ["uid"], "geo": ["q_geo", "geo"], "poiid": ["poi_id"], "cate": ["category"], "layer": ["layer"]}
    counts = dictionary.value_counts(rows, {k: [F.col(c) for c in cs] for k, cs in keys.items()})
    fixed = dictionary.value_counts(rows, {
        "qtype": [F.lit("0"), F.lit("1")], "hour": [F.lit("0"), F.lit("1"), F.lit("2")],
    })
    unknown = dictionary.unknown_rows(rows, [*keys, "qtype", "hour"])
    ids = dictionary.number(counts.unionByName(fixed).unionByName(unknown))
    with kept():
        return lines, materialise(ids, "ids")


# Rows of these layers have no features, and a third of the items are in no index.
SQL_RATIO = """len(list_intersect(string_split(query, ' '), string_split(replace(name_address, '|', ' '), ' '))) / len(list_distinct(string_split(query, ' ')))"""
SQL_UNION_DENSE = f"""list_transform(CASE WHEN layer % 10 = 3 THEN
    CAST([km, (show_pos > 0)::INT, show_pos, 0, layer, 0, show_pos + 1, 0, layer * 2] AS DOUBLE[]) || [0.0::DOUBLE for i in range(82)] || [CAST(layer AS DOUBLE) for i in range(41)]
    || [0.0::DOUBLE for i in range(41)] || [CAST(show_pos AS DOUBLE) for i in range(41)] || [CAST({SQL_RATIO} AS DOUBLE)]
  ELSE CAST([f1, f2, f3, f4] AS DOUBLE[]) || [0.0::DOUBLE for i in range(210)] || [CAST({SQL_RATIO} AS DOUBLE)] END,
  lambda v, i: CAST(round((CASE WHEN i <= 4 THEN v ELSE log2(v + 2) - 1 END) * 10000) AS BIGINT))"""


@check("job_union_rows", "impressions places searchers", f"""
WITH {SQL_VOCAB}, x AS (SELECT *, split_part(name_address, '|', 1) AS nm, split_part(name_address, '|', 2) AS ad FROM impressions),
{sql_ids('x', 'impression_id', 'query', 'q')}, {sql_ids('x', 'impression_id', 'nm', 'a')}, {sql_ids('x', 'impression_id', 'ad', 'b')},
idx AS (SELECT poi_id, row_number() OVER (ORDER BY poi_id) - 1 AS idx FROM places),
k AS (SELECT i.*, {SQL_KM} AS km, CASE WHEN i.poi_id % 3 > 0 THEN idx ELSE 0 END AS poi_idx
  FROM impressions i JOIN places p ON p.poi_id = i.poi_id JOIN searchers s ON s.uid = i.uid JOIN idx ON idx.poi_id = i.poi_id)
SELECT impression_id, CAST(poi_idx AS INT) AS poi_idx, 1 AS query_side,
  CASE WHEN search_id % 24 BETWEEN 6 AND 11 THEN 0 WHEN search_id % 24 BETWEEN 12 AND 17 THEN 1 ELSE 2 END AS hour_id,
  label - 1 AS label, least(label, 1) AS quantiser_label, layer, CAST(least(floor(log2(1 + km)), 15) AS INT) AS distance_id,
  array_to_string({SQL_UNION_DENSE}, ',') AS dense,
  {sql_fit('[4] || q.ids || [5]', 32)} AS query_token_ids, {sql_fit('[4] || a.ids || [5] || b.ids || [5]', 32)} AS poi_token_ids
FROM k JOIN q USING (impression_id) JOIN a USING (impression_id) JOIN b USING (impression_id)""")
def job_union_rows(spark, d):
    kind = F.when(F.col("label") == 2, "pos").when(F.col("label") == 1, "show_hard").otherwise("easy")
    rows = _located(spark, d).withColumns({"sample_type": kind, "f": F.when(F.col("layer") % 10 != 3, F.col("f"))})
    index = item_index(tables.places(spark, d)).where("poi_id % 3 > 0")
    repeat = lambda c: F.array_repeat(F.col(c).cast("double"), 41)
    out = jobs.union_rows(
        rows, vocabulary(spark, d), index,
        {"common_end": F.col("layer"), "common_start": F.lit(7), "person_end": F.col("show_pos") + 1, "person_start": F.lit(8), "common_total": F.col("layer") * 2},
        {"dest_query_geohash": repeat("layer"), "start_query_geohash": repeat("layer"), "dest_pid_city": repeat("show_pos")}, F.col("show_pos"), form=ints, dense_form=scaled_text)
    return out.select(
        "impression_id", "poi_idx", "query_side", "hour_id", "label", "quantiser_label", "layer", "distance_id",
        "dense", "query_token_ids", "poi_token_ids",
    )


# Trigrams of this many occurrences or fewer are unknown; dense lists by feature index (0 is the show position, 9 has no value).
RARE_TRIGRAM = 60
DENSE = {"top": [4, 2, 0, 9], "raw": [1, 3], "pid_city": [2, 2, 1]}
SINGLE = {"uid_id": ("uid", "uid"), "city_idx": ("cityid", "city_id"), "poi_idx": ("poiid", "poi_id"), "layer_id": ("layer", "layer")}
LISTS = {"query_trigrams": ("trigram", "query", 32), "name_trigrams": ("trigram", "name_address", 32), "category_ids": ("category", "category", 10)}
PAIR_QUERY = ["uid_id", "city_idx", "hour_id", "side_id", "query_trigrams"]
PAIR_ITEM = ["impression_id", "poi_idx", "layer_id", "category_ids", "name_trigrams", "token_ids", "segment_ids", "mask_ids", *DENSE, "click_label", "order_label"]


def _multitask_sql():
    grams = lambda c: f"CASE WHEN length({c}) < 3 THEN [lower({c})] ELSE [substring(lower({c}), i, 3) for i in range(1, length({c}) - 1)] END"
    hour = "CASE WHEN search_id % 24 BETWEEN 6 AND 11 THEN '0' WHEN search_id % 24 BETWEEN 12 AND 17 THEN '1' ELSE '2' END"
    unknown = ", ".join(f"'{k}'" for k in ("trigram", "uid", "cityid", "poiid", "layer", "category", "hour", "qtype"))
    unk = lambda key: f"(SELECT idx FROM dict WHERE dict_key = '{key}' AND value = 'UNK')"
    one = {**{n: (k, f"CAST({c} AS STRING)") for n, (k, c) in SINGLE.items()}, "hour_id": ("hour", hour), "side_id": ("qtype", "'1'")}
    ids = ", ".join(f"coalesce(d_{n}.idx, {unk(k)}) AS {n}" for n, (k, _) in one.items())
    joins = "\n".join(f"LEFT JOIN dict d_{n} ON d_{n}.dict_key = '{k}' AND d_{n}.value = {c}" for n, (k, c) in one.items())
    cut = lambda n, width: f"array_to_string([coalesce(l_{n}.ids[i], 0) for i in range(1, {width} + 1)], ',') AS {n}"
    z = lambda i: "round(show_pos * 10000)" if i == 0 else f"round((f{i} - m{i}) / s{i} * 10000)" if i < 5 else "0"
    dense = ", ".join(f"concat_ws(',', {', '.join(f'CAST({z(i)} AS BIGINT)' for i in ix)}) AS {n}" for n, ix in DENSE.items())
    pair = lambda p, n: ", ".join([*(f"p.{c}" for c in PAIR_QUERY), *(f"{x}.{c} AS {y}_{c}" for x, y in ((p, "pos"), (n, "neg")) for c in PAIR_ITEM)])
    return f"""
WITH {SQL_VOCAB}, {SQL_TAKEN}, im AS (SELECT *, split_part(name_address, '|', 1) AS nm, split_part(name_address, '|', 2) AS ad FROM impressions),
st AS (SELECT {", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(1, 5))} FROM impressions),
texts AS (SELECT 'trigram' AS dict_key, query AS text, {grams("query")}[1:32] AS vs FROM (SELECT DISTINCT query FROM im)
  UNION SELECT 'trigram', name_address, {grams("name_address")}[1:32] FROM (SELECT DISTINCT name_address FROM im)
  UNION SELECT 'category', category, [category] FROM (SELECT DISTINCT category FROM im)),
counted AS (SELECT 'trigram' AS dict_key, value, count(*) AS cnt FROM (
    SELECT unnest({grams("query")}) AS value FROM im UNION ALL SELECT unnest({grams("name_address")}) FROM im) GROUP BY value HAVING count(*) > {RARE_TRIGRAM}
  {"".join(f"UNION ALL SELECT '{k}', CAST({c} AS STRING), count(*) FROM im GROUP BY {c} " for k, c in [*SINGLE.values(), ("category", "category")])}
  UNION ALL SELECT 'hour', {hour}, count(*) FROM im GROUP BY 2 UNION ALL SELECT 'qtype', '1', count(*) FROM im
  UNION ALL SELECT unnest([{unknown}]), 'UNK', (SELECT count(*) FROM im)),
dict AS (SELECT dict_key, value, CAST(row_number() OVER (PARTITION BY dict_key ORDER BY cnt DESC, value) AS INT) AS idx FROM counted),
lists AS (SELECT t.dict_key, text, list(coalesce(d.idx, CASE t.dict_key WHEN 'trigram' THEN {unk("trigram")} ELSE {unk("category")} END) ORDER BY pos) AS ids
  FROM (SELECT dict_key, text, unnest(vs) AS value, unnest(range(1, len(vs) + 1)) AS pos FROM texts) t
  LEFT JOIN dict d ON d.dict_key = t.dict_key AND d.value = t.value GROUP BY t.dict_key, text),
{sql_ids('im', 'impression_id', 'query', 'q')}, {sql_ids('im', 'impression_id', 'nm', 'n')}, {sql_ids('im', 'impression_id', 'ad', 'a')},
tok AS (SELECT impression_id, q.ids[1:28] AS qi, n.ids[1:28 - least(len(q.ids), 28)] AS ni,
  a.ids[1:28 - least(len(q.ids), 28) - least(len(n.ids), 28 - least(len(q.ids), 28))] AS ai FROM q JOIN n USING (impression_id) JOIN a USING (impression_id)),
seq AS (SELECT impression_id, [4] || qi || [5] || ni || [5] || ai || [5] AS ids, len(qi) + 2 AS k FROM tok),
e AS (SELECT im.impression_id, {ids}, {", ".join(cut(n, w) for n, (_, _, w) in LISTS.items())}, {sql_fit('seq.ids', 32)} AS token_ids,
  array_to_string([CASE WHEN i > k AND i <= len(seq.ids) THEN 1 ELSE 0 END for i in range(1, 33)], ',') AS segment_ids,
  array_to_string([CASE WHEN i <= len(seq.ids) THEN 1 ELSE 0 END for i in range(1, 33)], ',') AS mask_ids, {dense}
  FROM im JOIN seq ON seq.impression_id = im.impression_id
{joins}
{chr(10).join(f"LEFT JOIN lists l_{n} ON l_{n}.dict_key = '{k}' AND l_{n}.text = im.{c}" for n, (k, c, _) in LISTS.items())}, st),
t AS (SELECT *, count(*) OVER (PARTITION BY search_uid) AS group_len, label - 1 AS click_label, CASE data_type WHEN 'order' THEN label - 1 ELSE 0 END AS order_label
  FROM taken),
r AS (SELECT t.search_uid, t.data_type, t.group_len, t.click_label, t.order_label, e.* FROM t JOIN e USING (impression_id))
SELECT 'train' AS part, p.search_uid, p.data_type, p.group_len, {pair("p", "n")} FROM r p JOIN r n USING (search_uid) WHERE p.click_label = 1 AND n.click_label <> 1
UNION ALL SELECT 'test', p.search_uid, p.data_type, p.group_len, {pair("p", "p")} FROM r p WHERE data_type = 'order'"""


@check("job_multitask_pairs", "order_log places", _multitask_sql())
def job_multitask_pairs(spark, d):
    with scratch(spark):
        buckets, columns = _multitask_buckets(spark, d)
    part = lambda name, test: jobs.multitask_pairs(buckets, "search_uid", PAIR_QUERY, columns, test).select(F.lit(name).alias("part"), "*")
    return part("train", False).unionByName(part("test", True))


def _multitask_buckets(spark, d):
    """Encoded rows of both logs in buckets, which are kept, and the columns of an item."""
    im = tables.impressions(spark, d).select(
        "search_uid", "impression_id", "uid", "city_id", "poi_id", "layer", "category", "query", "name_address", "time_text", "query_type",
        "label", "line_status", "show_pos", "ltr_features")
    order = F.when(F.col("query_type") == 4, tables.order_label())
    im = materialise(im.withColumns({"f": features.parse_features(F.col("ltr_features")), "as_order": order}).drop("ltr_features"), "typed")
    # One row per feature index: a fixed number.
    stats = {r.idx: (r["mean"], r["std"]) for r in profile.feature_statistics(im.select(F.explode("f").alias("idx", "value"))).collect()}
    hour = calendar.hour_bucket(calendar.hour_of(F.col("time_text")))
    counts = dictionary.value_counts(im, {
        "trigram": [dictionary.Terms(F.col(c), text.char_trigrams) for c in ("query", "name_address")], "uid": [F.col("uid")], "cityid": [F.col("city_id")],
        "poiid": [F.col("poi_id")], "layer": [F.col("layer")], "category": [F.col("category")], "hour": [hour], "qtype": [F.lit("1")]})
    counts = dictionary.filter_by_count(counts, {"trigram": RARE_TRIGRAM})
    keys = ["trigram", "uid", "cityid", "poiid", "layer", "category", "hour", "qtype"]
    ids = materialise(dictionary.number(counts.unionByName(dictionary.unknown_rows(im, keys))), "ids")
    # Lists are shown where they are made, so once for each pair of texts or item and not for each pair of items.
    items = jobs.multitask_items(im, ids, vocabulary(spark, d), stats, DENSE, form=ints)
    items = items.withColumns({"category_ids": ints("category_ids"), **{c: scaled(c) for c in DENSE}})
    # Each item is in the click log, and once more in the order log if its search ended in an order.
    logs_of = F.array(F.struct(F.lit("click").alias("data_type"), F.col("label")), F.struct(F.lit("order").alias("data_type"), F.col("as_order").alias("label")))
    columns = [c for c in PAIR_ITEM if not c.endswith("_label")]
    rows = items.select("search_uid", *PAIR_QUERY, *columns, F.inline(F.filter(logs_of, lambda x: x["label"].isNotNull())))
    with kept():
        return jobs.search_buckets(rows, "search_uid"), columns


@check("job_feature_dictionary", "impressions", f"""
WITH q AS (SELECT search_uid, {sql_normalise('min(query)')} AS query FROM impressions GROUP BY search_uid),
s AS (SELECT q.query, {SQL_NAME} AS na, city_id, uid, poi_id, layer, category FROM impressions JOIN q USING (search_uid)
  WHERE label >= 1 AND country_code IN ('ASIA', 'EUROPE', 'AFRICA')),
v AS (SELECT 'trigram' AS dict_key, unnest([substring(t, i, 3) for i in range(1, length(t) - 1)]) AS value FROM (SELECT unnest([lower(query), lower(na)]) AS t FROM s)
  UNION ALL SELECT 'cityid', CAST(city_id AS STRING) FROM s UNION ALL SELECT 'uid', CAST(uid AS STRING) FROM s
  UNION ALL SELECT 'poiid', CAST(poi_id AS STRING) FROM s UNION ALL SELECT 'layer', CAST(layer AS STRING) FROM s
  UNION ALL SELECT 'category', category FROM s UNION ALL SELECT 'geohash', '[UNK]' FROM s)
SELECT dict_key, value, count(*) AS cnt FROM v GROUP BY ALL
UNION ALL SELECT unnest(['trigram', 'cityid', 'uid', 'comp_label_id', 'poiid', 'category', 'layer', 'geohash']), 'UNK', (SELECT count(*) FROM s)""")
def job_feature_dictionary(spark, d):
    path = new_path(spark, "log")
    logs.write_log(tables.search_log(spark, d), path)
    log = logs.union_countries(spark, path, "1990-01-01", "2030-12-31", ["ASIA", "EUROPE", "AFRICA"])
    return jobs.feature_dictionary(records.samples(log))
