"""Sample-building jobs: the compositions a user runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.fields import ITEM_FIELDS, QUERY_FIELDS
from rankspark.functions import calendar, features, geo, text, tokens
from rankspark.operators import dictionary, encoding, groups, models, pairs, records, similarity, skew
from rankspark.session import bucketed, kept, materialise, scratch


SHORT = tokens.SHORT_TOKEN_LENGTH


def _expand(rows: DataFrame, encoded: dict[str, Column]) -> DataFrame:
    """Add token, segment and mask columns for each encoded text."""
    out = rows.withColumns({f"_{p}": c for p, c in encoded.items()})
    parts = ("token_ids", "segment_ids", "mask_ids")
    return out.withColumns(
        {f"{p}_{x}": F.col(f"_{p}.{x}") for p in encoded for x in parts}
    ).drop(*[f"_{p}" for p in encoded])


def name_and_address(column: str = "name_address") -> tuple[Column, Column]:
    parts = F.split(column, r"\|")
    return F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit(""))


# ---------------------------------------------------------------- ranking samples


def gbdt_samples(rows: DataFrame, key: str, item: str, order: Sequence[Column]) -> DataFrame:
    """Samples with the first row per item of a search and the new group length."""
    return groups.dedup_items(rows, key, item, order)


# Names of the statistics.
COUNTS = "common_end common_start person_end person_start common_total".split()
GROUPS = "dest_query_city dest_pid_query_city dest_query_geohash start_query_geohash dest_pid_city".split()


def _statistics(km, ratio, counts, groups, click_score, source_tag) -> Column:
    """Statistic features; what is left out counts as missing."""
    none = F.lit(None).cast("array<double>")
    return features.masked_statistics(
        F.col("query_type"), km, F.lit(None).cast("double") if click_score is None else click_score,
        F.lit(None).cast("string") if source_tag is None else source_tag,
        {k: F.lit(None) for k in COUNTS} | (counts or {}), {k: none for k in GROUPS} | (groups or {}), ratio,
    )


def similarity_samples(
    rows: DataFrame, queries: DataFrame, names: DataFrame, addrs: DataFrame,
    counts: dict[str, Column] | None = None, groups: dict[str, Column] | None = None,
    click_score: Column | None = None, source_tag: Column | None = None,
) -> DataFrame:
    """Rows with a ``dense`` list: 23 similarity, 6 other and 215 statistic features.

    Rows carry query, name, addr, query_type and both coordinates. ``counts`` and ``groups``
    (41 numbers each) give the statistics by the names in COUNTS and GROUPS; those left out,
    a score or a tag left out, are taken as missing. Pass written rows (see ``per_texts``).
    """
    r = similarity.similarity_features(rows, queries, names, addrs)
    km = geo.haversine_km(F.col("lng"), F.col("lat"), F.col("item_lng"), F.col("item_lat"))
    _, ratio = text.token_overlap(F.col("query"), F.concat_ws("|", "name", "addr"))
    zero = F.lit(0.0)
    statistics = _statistics(km, ratio, counts, groups, click_score, source_tag)
    other = F.array(zero, (F.col("query_type") == 1).cast("double"), zero, km, zero, zero)
    return r.withColumn("dense", F.concat("sim", other, statistics)).drop("sim")


def pair_samples(
    rows: DataFrame, key: str, ids: DataFrame, id_fields: dict[str, tuple[str, str]], tree_model,
    stats: dict[int, tuple[float, float]], keep: Sequence[str] = (),
) -> DataFrame:
    """Ids, leaves, tree score and scaled features of each item, with those of the search's
    top item in front. Without a tree model (None), leaves and score are left out.

    ``stats``: feature index -> (median, minimum); these features are scaled. The rows are scored and
    written once, with the columns of the output alone.
    """
    scored = rows if tree_model is None else models.with_leaves(tree_model, rows)
    scaled = F.array(*[
        features.median_ratio_log(
            F.coalesce(F.try_element_at("f", F.lit(i)), F.lit(0.0)), F.lit(float(median)), F.lit(float(low))
        )
        for i, (median, low) in sorted(stats.items())
    ])
    made = [*([] if tree_model is None else ["leaves", "tree_score"]), "scaled", "label", *keep]
    used = dict.fromkeys([key, "show_pos", "impression_id", *[column for column, _ in id_fields.values()], *made])
    with scratch(rows.sparkSession):
        coded = dictionary.look_up(scored.withColumn("scaled", scaled).select(*used), ids, id_fields)
        with kept():
            ready = materialise(coded.select(*dict.fromkeys([key, "show_pos", "impression_id", *id_fields, *made])), "ready")
    return pairs.top_with_all(ready, key, [*id_fields, *made])


# ---------------------------------------------------------------- retrieval samples

POI_COLUMNS = (
    "poiid name addr lng lat area country area_id geocode_id click_score category_ids country_str ac"
).split()


def poi_tokens(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """POI lines to token ids of ``name|addr alias`` with padded categories and their mask."""
    f = F.split("value", r"\|\|")
    rows = lines.where(F.size(f) == len(POI_COLUMNS)).select(
        *[F.get(f, i).alias(c) for i, c in enumerate(POI_COLUMNS)]
    )
    full = tokens.append_alias(F.col("name"), F.col("addr"), F.col("ac"))
    rows = rows.withColumn("_second", F.get(F.split(full, r"\|"), 1))
    rows = encoding.with_ids(rows, {"name": "_n", "_second": "_a"}, vocabulary)
    categories, mask = tokens.pad_categories(F.split("category_ids", "#").cast("array<int>"))
    rows = _expand(rows, {"poi": tokens.encode_pair(F.col("_n"), F.col("_a"), SHORT)})
    return rows.select(
        F.col("poiid").cast("bigint").alias("poi_id"), F.col("area").alias("city"), "poi_token_ids",
        F.col("area_id").cast("int").alias("area_id"), F.col("geocode_id").cast("int").alias("geocode_id"),
        F.col("click_score").cast("double").alias("click_score"),
        categories.alias("category_ids"), mask.alias("category_mask"),
    )


QUERY_COLUMNS = "searchid country cityid poiid query pstnm negatives birth_time uniq_id correct_type queue".split()
EXTRA_COLUMNS = "query_type area_id geohash_id week_bucket day_bucket".split()


def _query_fields(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    f = F.split(F.trim(F.get(F.split("value", "\t"), 1)), "##")
    return lines.where(F.size(f) >= len(names)).select(*[F.get(f, i).alias(c) for i, c in enumerate(names)])


def query_rows(
    lines: DataFrame, vocabulary: DataFrame, item_index: DataFrame, city: str | None = None, min_length: int = 15
) -> DataFrame:
    """Query lines to token ids of query and clicked item, joined to the item's index.

    Queries shorter than ``min_length`` are left out; ``city`` restricts to a test city.
    """
    rows = _query_fields(lines, QUERY_COLUMNS).where(F.length("query") >= min_length)
    return _query_items(rows if city is None else rows.where(F.col("cityid") == city), vocabulary, item_index, [])


def multifeature_rows(
    lines: DataFrame, vocabulary: DataFrame, item_index: DataFrame, test_city: str | None = None
) -> DataFrame:
    """Query lines with type, area, geohash, week and day ids. The test variant keeps one
    city and original samples only."""
    rows = _query_fields(lines, QUERY_COLUMNS + EXTRA_COLUMNS)
    if test_city is not None:
        rows = rows.where((F.col("cityid") == test_city) & (F.col("correct_type") == "origin"))
    return _query_items(rows, vocabulary, item_index, EXTRA_COLUMNS)


def _query_items(rows, vocabulary, item_index, extra):
    name, addr = name_and_address("pstnm")
    rows = rows.withColumns({"_name": name, "_addr": addr})
    rows = encoding.with_ids(rows, {"query": "_q", "_name": "_n", "_addr": "_a"}, vocabulary)
    rows = _expand(rows, {
        "query": tokens.encode(F.col("_q"), SHORT), "poi": tokens.encode_pair(F.col("_n"), F.col("_a"), SHORT),
    })
    out = rows.select(
        "uniq_id", F.col("poiid").cast("bigint").alias("poi_id"), F.col("cityid").cast("int").alias("city_id"), "pstnm",
        "query_token_ids", "query_segment_ids", "query_mask_ids", "poi_token_ids",
        *[F.col(c).cast("int").alias(c) for c in extra],
    )
    return out.join(item_index, "poi_id")


def labelled_pairs(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Query-item lines to token ids with two labels; hard negatives count as positive in the first."""
    f = F.split("value", "\t")
    rows = records.min_fields(lines, 6).select(
        F.get(f, 0).cast("bigint").alias("query_idx"), F.get(f, 1).alias("query"),
        F.get(f, 3).cast("bigint").alias("poi_idx"), F.get(f, 4).alias("name_address"), F.get(f, 5).alias("kind"),
    )
    name, addr = name_and_address()
    rows = rows.withColumns({"_name": name, "_addr": addr})
    rows = encoding.with_ids(rows, {"query": "_q", "_name": "_n", "_addr": "_a"}, vocabulary)
    rows = _expand(rows, {
        "query": tokens.encode(F.col("_q"), SHORT), "poi": tokens.encode_pair(F.col("_n"), F.col("_a"), SHORT),
    })
    return rows.select(
        "query_idx", "poi_idx",
        *[f"{p}_{x}" for p in ("query", "poi") for x in ("token_ids", "segment_ids", "mask_ids")],
        F.col("kind").isin("positive", "hard_negative").cast("int").alias("label"),
        (F.col("kind") == "positive").cast("int").alias("origin_label"),
    )


def triplets(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Lines of query, positive and negative name to token ids."""
    f = F.split("value", "\t")
    rows = records.min_fields(lines, 3).select(*[F.get(f, i).alias(c) for i, c in enumerate(("query", "pos", "neg"))])
    for side in ("pos", "neg"):
        name, addr = name_and_address(side)
        rows = rows.withColumns({f"_{side}_name": name, f"_{side}_addr": addr})
    rows = encoding.with_ids(
        rows, {"query": "_q", "_pos_name": "_pn", "_pos_addr": "_pa", "_neg_name": "_nn", "_neg_addr": "_na"}, vocabulary
    )
    rows = _expand(rows, {
        "query": tokens.encode(F.col("_q"), SHORT),
        "pos": tokens.encode_pair(F.col("_pn"), F.col("_pa"), SHORT),
        "neg": tokens.encode_pair(F.col("_nn"), F.col("_na"), SHORT),
    })
    return rows.select(
        *[f"{p}_{x}" for p in ("query", "pos", "neg") for x in ("token_ids", "segment_ids", "mask_ids")],
        F.lit(1).alias("label"),
    )


def group_triplets(rows: DataFrame, key: str, row_id: str, vocabulary: DataFrame) -> DataFrame:
    """Clicked item against each item not clicked, the query in front of both."""
    p = pairs.clicked_against_rest(rows, key, ["name_address"])
    p = encoding.with_ids(p, {"query": "_q", "pos_name_address": "_p", "name_address": "_n"}, vocabulary)
    p = _expand(p, {
        "pos": tokens.encode_pair(F.col("_q"), F.col("_p"), 2 * SHORT),
        "neg": tokens.encode_pair(F.col("_q"), F.col("_n"), 2 * SHORT),
    })
    return p.select(
        row_id, *[f"{s}_{x}" for s in ("pos", "neg") for x in ("token_ids", "segment_ids", "mask_ids")],
        F.lit(1).alias("label"),
    )


RANK_COLUMNS = "city query uid q_latlng time_text query_type q_geo items search_key page".split()
RANK_ITEM = "label show_pos poi_id name_address lat lng category layer geo".split()


def rank_rows(lines: DataFrame, vocabulary: DataFrame, ids: DataFrame, city: str | None = None) -> DataFrame:
    """Rank lines to rows of the clicked item with each other item of its line.

    A line holds a search, or a page of one: its fields, its items joined by a double bar,
    and what names the search and the page. Lines without these two are searches of their own.
    """
    f = F.split("value", "\t")
    rows = records.min_fields(lines, 8).select("value", *[F.get(f, i).alias(c) for i, c in enumerate(RANK_COLUMNS)])
    if city is not None:
        rows = rows.where(F.col("city") == city)
    rows = rows.withColumns({
        "search": F.coalesce("search_key", F.sha2(F.col("value"), 256)),
        "page": F.coalesce(F.col("page").cast("int"), F.lit(0)),
        "side": F.when(F.col("query_type") == "0", "0").otherwise("1"),
        "hour": calendar.hour_bucket(calendar.hour_of(F.col("time_text"))).cast("string"),
    })
    item = F.split(F.col("_item"), "##")
    rows = rows.select("*", F.posexplode(F.split("items", r"\|\|")).alias("listed", "_item")).where(F.size(item) >= 7)
    rows = rows.select(
        *[c for c in rows.columns if c not in ("value", "items", "_item", "page", "listed")],
        (F.col("page") * groups.PAGE_ROWS + F.col("listed")).alias("listed"), *[F.get(item, i).alias(c) for i, c in enumerate(RANK_ITEM)]
    )
    coded = dictionary.look_up(rows, ids, {
        "uid_id": ("uid", "uid"), "q_geo_id": ("q_geo", "geo"), "side_id": ("side", "qtype"), "hour_id": ("hour", "hour"),
        "poi_idx": ("poi_id", "poiid"), "geo_id": ("geo", "geo"), "category_id": ("category", "cate"), "layer_id": ("layer", "layer"),
    })
    name, addr = name_and_address()
    coded = coded.withColumns({"_name": name, "_addr": addr})
    coded = encoding.with_ids(coded, {"query": "_q", "_name": "_n", "_addr": "_a"}, vocabulary)
    double = lambda c: F.col(c).try_cast("double")
    corner = lambda i: F.get(F.split("q_latlng", r"\|"), i).try_cast("double")
    km = geo.haversine_km(corner(1), corner(0), double("lng"), double("lat"))
    coded = coded.withColumn("distance_id", F.coalesce(geo.distance_bucket(km), F.lit(0)))

    marks = lambda *xs: F.array(*[F.lit(x) for x in xs])
    separated = lambda *cs: F.array(*[x for c in cs for x in (F.col(c), F.lit(tokens.SEP))])
    query_side, item_side = ("q_geo_id", "side_id", "hour_id"), ("geo_id", "category_id", "layer_id")
    zeros = F.array_repeat(F.lit(0), 6)
    ones = lambda n: F.array_repeat(F.lit(1), n)
    coded = _expand(coded, {
        "query": tokens.append_features(
            tokens.encode(F.col("_q"), SHORT), separated(*query_side), marks(2, 2, 3, 3, 4, 4), ones(6), SHORT + 12
        ),
        "poi": tokens.append_features(
            tokens.encode_pair(F.col("_n"), F.col("_a"), SHORT), F.concat(zeros, separated(*item_side)),
            F.concat(zeros, marks(5, 5, 6, 6, 7, 7)), F.concat(zeros, ones(6)), SHORT + 12,
        ),
        "cross": tokens.append_features(
            tokens.encode_triple(F.col("_q"), F.col("_n"), F.col("_a"), SHORT),
            separated(*query_side, *item_side, "distance_id"),
            marks(2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8), ones(14), SHORT + 14,
        ),
    })
    n_match, ratio = text.token_overlap(F.col("query"), F.col("name_address"))
    ready = coded.select(
        "search", "query", "uid_id", "listed", F.col("label").cast("int").alias("label"),
        F.col("show_pos").cast("int").alias("show_pos"), "poi_id", "poi_idx", "distance_id",
        ((F.col("label") == "2") | (F.col("listed") < 3)).cast("int").alias("new_label"),
        n_match.alias("n_match"), ratio.alias("match_ratio"),
        F.concat_ws("-", "search", "listed").alias("impression_id"),
        *[f"{p}_{x}" for p in ("query", "poi", "cross") for x in ("token_ids", "segment_ids", "mask_ids")],
    )
    return pairs.clicked_hard_easy(
        ready, "search", ["poi_id", "poi_idx", "poi_token_ids", "cross_token_ids", "match_ratio", "n_match"]
    )


#: Lists made of one text of a row alone.
UNION_QUERY, UNION_POI = ([f"{p}_{x}" for x in ("token_ids", "segment_ids", "mask_ids")] for p in ("query", "poi"))


def union_texts(rows: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, lists of UNION_QUERY) and (name_address, lists of UNION_POI), one row per distinct text each."""
    texts = materialise(rows.select("query", "name_address").distinct(), "text-pairs")
    queries = encoding.with_ids(texts.select("query").distinct(), {"query": "_q"}, vocabulary)
    name, addr = name_and_address()
    items = texts.select("name_address").distinct().withColumns({"_name": name, "_addr": addr})
    items = encoding.with_ids(items, {"_name": "_n", "_addr": "_a"}, vocabulary)
    queries = _expand(queries, {"query": tokens.encode(F.col("_q"), SHORT)})
    items = _expand(items, {"poi": tokens.encode_pair(F.col("_n"), F.col("_a"), SHORT)})
    return queries.select("query", *UNION_QUERY), items.select("name_address", *UNION_POI)


def union_rows(
    rows: DataFrame, vocabulary: DataFrame, item_index: DataFrame | None = None,
    counts: dict[str, Column] | None = None, groups: dict[str, Column] | None = None,
    click_score: Column | None = None, source_tag: Column | None = None,
    form: Callable[[Column], Column] | None = None, dense_form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Samples to text ids and dense features per item, with model and quantiser labels.

    Rows carry query, name_address, query_type, time_text, layer, label, sample_type, poi_id,
    features ``f`` and both coordinates. Rows without features get the statistic features
    instead, of the same width (see :func:`similarity_samples` for ``counts`` to ``source_tag``).
    ``item_index`` (poi_id, idx): items that it lacks, or all without it, have ``poi_idx`` 0.
    ``form``: how the lists of token, segment and mask ids are written, as they are unless given. They
    are made once for each distinct text, whichever rows hold it. ``dense_form``: the text of a dense
    value; ``dense`` is these joined by commas then, else the list.
    """
    queries, items = union_texts(rows, vocabulary)
    if form is not None:
        queries = queries.withColumns({c: form(F.col(c)) for c in UNION_QUERY})
        items = items.withColumns({c: form(F.col(c)) for c in UNION_POI})
    if item_index is None:
        rows = rows.withColumn("poi_idx", F.lit(0))
    else:
        own = item_index.select(F.col("poi_id").alias("_poi"), F.col("idx").cast("int").alias("poi_idx"))
        rows = rows.join(own, F.col("poi_id") == F.col("_poi"), "left").drop("_poi").withColumn("poi_idx", F.coalesce("poi_idx", F.lit(0)))
    r = skew.attach(skew.attach(rows, queries, ["query"]), items, ["name_address"])
    _, ratio = text.token_overlap(F.col("query"), F.col("name_address"))
    km = geo.haversine_km(F.col("lng"), F.col("lat"), F.col("item_lng"), F.col("item_lat"))
    statistics = _statistics(km, ratio, counts, groups, click_score, source_tag)
    if dense_form is None:
        dense = features.dense_log2(F.when(F.col("f").isNotNull(), features.reindex(F.col("f"), ratio)).otherwise(statistics))
    else:
        texts = F.array_join(features.dense_log2(statistics, dense_form), ",")
        dense = F.when(F.col("f").isNotNull(), features.reindex_text(F.col("f"), ratio, dense_form)).otherwise(texts)
    return r.select(
        "search_uid", "impression_id", "query", "poi_idx",
        F.when(F.col("query_type").cast("string") == "0", 0).otherwise(1).alias("query_side"),
        calendar.hour_bucket(calendar.hour_of(F.col("time_text"))).alias("hour_id"),
        (F.col("label") - 1).alias("label"),
        F.col("sample_type").isin("pos", "show_hard", "re_hard").cast("int").alias("quantiser_label"),
        F.col("layer").cast("int").alias("layer"), geo.distance_bucket(km).alias("distance_id"),
        dense.alias("dense"), "name_address", *UNION_QUERY, *UNION_POI,
    )


# ---------------------------------------------------------------- multi-task pairs

MULTITASK_QUERY = "query_trigrams uid_id city_idx hour_id side_id q_geo_id component_ids".split()
MULTITASK_ITEM = "poi_idx geo_id category_ids name_trigrams layer_id token_ids segment_ids mask_ids".split()
#: Fields read from the rows and what stands for one that they lack.
MULTITASK_DEFAULTS = {"q_geohash": "", "geohash": "", "component_ids": ""}


#: Lists made of the query and the name_address of a row alone.
MULTITASK_TEXT = "query_trigrams name_trigrams token_ids segment_ids mask_ids".split()


def multitask_texts(rows: DataFrame, ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query, name_address) with the lists of MULTITASK_TEXT, one row per distinct pair of both."""
    texts = materialise(rows.select("query", "name_address").distinct(), "text-pairs")
    coded = encoding.list_ids(texts, {
        "query_trigrams": ("query", "trigram", text.char_trigrams, SHORT), "name_trigrams": ("name_address", "trigram", text.char_trigrams, SHORT),
    }, ids)
    name, addr = name_and_address()
    coded = encoding.with_ids(coded.withColumns({"_name": name, "_addr": addr}), {"query": "_q", "_name": "_n", "_addr": "_a"}, vocabulary)
    coded = coded.withColumn("_t", tokens.encode_triple(F.col("_q"), F.col("_n"), F.col("_a"), SHORT))
    coded = coded.withColumns({c: F.col(f"_t.{c}") for c in ("token_ids", "segment_ids", "mask_ids")})
    return coded.select("query", "name_address", *MULTITASK_TEXT)


def multitask_items(
    rows: DataFrame, ids: DataFrame, vocabulary: DataFrame, stats: dict[int, tuple[float, float]],
    dense: dict[str, Sequence[int]], tree_model=None, form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows with the encoded columns of the multi-task format: MULTITASK_QUERY, MULTITASK_ITEM, the
    lists of ``dense`` and, with a tree model (its features in ``features``), leaves and tree_score.

    Rows carry query, name_address, uid, city_id, time_text, query_type, poi_id, category, layer,
    show_pos and the feature map ``f``; geohashes and component ids are empty where left out.
    ``stats``: feature index -> (mean, deviation) for z-scores; a feature without them stays as it
    is. ``dense``: name of a list -> its feature indexes, 0 being the show position. ``form``: how the
    lists of MULTITASK_TEXT are written, as they are unless given. They are made once for each
    distinct pair of texts, whichever rows hold it. Pass written rows, so that they aren't evaluated twice.
    """
    texts = multitask_texts(rows, ids, vocabulary)
    if form is not None:
        texts = texts.withColumns({c: form(F.col(c)) for c in MULTITASK_TEXT})
    have = set(rows.columns)
    rows = rows.withColumns({c: F.lit(v) for c, v in MULTITASK_DEFAULTS.items() if c not in have})
    rows = rows.withColumns({
        "_components": F.col("component_ids"), "_hour": calendar.hour_bucket(calendar.hour_of(F.col("time_text"))).cast("string"),
        "_side": F.when(F.col("query_type").cast("string") == "0", "0").otherwise("1"),
    }).drop("component_ids")
    listed = lambda c: F.filter(F.split(c, "[;,]"), lambda v: v != "")
    coded = encoding.list_ids(rows, {
        "category_ids": ("category", "category", listed, 10), "component_ids": ("_components", "comp_label_id", listed, 10)}, ids)
    coded = dictionary.look_up(coded, ids, {
        "uid_id": ("uid", "uid"), "city_idx": ("city_id", "cityid"), "hour_id": ("_hour", "hour"), "side_id": ("_side", "qtype"),
        "q_geo_id": ("q_geohash", "geohash"), "poi_idx": ("poi_id", "poiid"), "geo_id": ("geohash", "geohash"), "layer_id": ("layer", "layer"),
    })
    coded = skew.attach(coded, texts, ["query", "name_address"])
    if tree_model is not None:
        coded = models.with_leaves(tree_model, coded)

    def scaled(i: int, x: Column) -> Column:
        return features.zscore(x, *map(F.lit, map(float, stats[i]))) if i in stats else x

    slot = lambda i: scaled(i, features.slot_of(F.col("f"), F.col("show_pos"), i))
    lists = {out: F.array(*[slot(i) for i in indexes]) for out, indexes in dense.items()}
    return coded.withColumns(lists).drop(*[c for c in coded.columns if c.startswith("_")])


def _chosen_rows(rows: DataFrame, key: str, test: bool, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Rows of the source that a search is taken from, with ``group_len``, its rows in that source."""
    of = lambda kind: F.count(F.when(F.col("data_type") == kind, 1))
    sizes = rows.groupBy(key).agg(of("click").alias("_n_click"), of("order").alias("_n_order"))
    if not test:
        sizes = sizes.where("_n_click > 0")
    order = F.lit(True) if test else F.col("_n_order") > 0
    taken = join(rows, sizes).where(F.when(order, F.col("data_type") == "order").otherwise(F.col("data_type") == "click"))
    length = F.when(F.col("data_type") == "order", F.col("_n_order")).otherwise(F.col("_n_click"))
    return taken.withColumn("group_len", length.cast("int")).drop("_n_click", "_n_order")


def search_buckets(rows: DataFrame, key: str, hot_rows: int = skew.HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows bucketed and sorted by the search, and those of hot searches (written, or None)."""
    with scratch(rows.sparkSession):
        ordinary, hot = skew.split_hot(materialise(rows, "rows"), key, hot_rows)
        with kept():
            hot = hot if hot is None else materialise(hot, "hot-searches")
            return bucketed(ordinary, [key], "searches"), hot


def multitask_pairs(
    rows: tuple[DataFrame, DataFrame | None], key: str, group_columns: Sequence[str], item_columns: Sequence[str], test: bool = False
) -> DataFrame:
    """Training pairs from the click and order logs (``data_type`` says which a row is of): where a
    search of the click log has order rows they take the place of its click rows, then every positive
    meets every negative. Test format: each order row is paired with itself.

    ``rows`` are those of both logs as :func:`search_buckets` writes them, once for all formats.
    Counting a search's rows, choosing its source and pairing all read these buckets, so nothing
    above them is exchanged. Searches with a large share of all rows don't go into a bucket: they
    are joined by adaptive shuffles, which split them. Rows without a search are left out.
    """
    group_columns = ["group_len", "data_type", *group_columns]
    item_columns = [*item_columns, "click_label", "order_label"]
    labelled = lambda df: df.select("*", *records.task_labels(F.col("data_type"), F.col("label")))

    def paired(taken: DataFrame) -> DataFrame:
        taken = labelled(taken)
        if test:
            return pairs.self_pairs(taken, key, group_columns, item_columns)
        return pairs.positive_negative(taken, key, group_columns, item_columns, F.col("click_label") == 1)

    ordinary, hot = rows
    out = paired(_chosen_rows(ordinary, key, test, lambda df, sizes: df.join(sizes, key)))
    if hot is not None:
        taken = _chosen_rows(hot, key, test, lambda df, sizes: skew.attach(df, sizes, [key]))
        out = out.unionByName(paired(materialise(taken, "hot-searches")))
    return out


# ---------------------------------------------------------------- dictionary


def feature_dictionary(samples: DataFrame) -> DataFrame:
    """(dict_key, value, cnt) over the configured fields of samples, filtered by the
    fields' thresholds, with one UNK entry per field."""
    values: dict[str, list[Column]] = {}
    for spec in QUERY_FIELDS + ITEM_FIELDS:
        if spec.dict_key is None:
            continue
        column = F.col(spec.source)
        if spec.dict_key == "trigram":
            column = dictionary.Terms(column, text.char_trigrams)
        elif spec.width:
            column = F.filter(F.split(column, "[;,]"), lambda v: v != "")
        values.setdefault(spec.dict_key, []).append(column)
    counts = dictionary.value_counts(samples, values)
    kept = dictionary.filter_by_count(counts, dictionary.thresholds_of(QUERY_FIELDS + ITEM_FIELDS))
    return kept.unionByName(dictionary.unknown_rows(samples, list(values)))
