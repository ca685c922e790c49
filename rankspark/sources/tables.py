"""Business tables and the search-log views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.operators.skew import HOT_ROWS, HOT_SHARE, group_positions

LOG_PAGE_ITEMS = 1000


# Schemas by path: inferring one takes a Spark job, and the tables never change.
_SCHEMAS: dict[str, T.StructType] = {}


#: Session option: deal the rows of the large tables out over so many tasks. Off unless set; meant for
#: tables of one file with one row group, which a scan can't split. Stored data of many files needs no exchange.
SCAN_PARTITIONS = "spark.rankspark.scanPartitions"
LARGE = frozenset({"lineitem", "orders", "documents", "events", "pages"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    rows = spark.read.schema(_SCHEMAS[path]).parquet(path)
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return rows.repartition(int(n)) if n and name in LARGE else rows


def impressions(spark: SparkSession, sf_dir: str, items: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Search log, one row per listed item: a search is an order, an item is a part.

    Columns of ``items`` (by poi_id) and ``users`` (by uid) are added to the rows that have them. They
    are joined to the parts and customers, so that the rows needn't be dealt out for them.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    part = table(spark, sf_dir, "part")
    own = []
    if items is not None:
        own += [c for c in items.columns if c != "poi_id"]
        part = part.join(items.withColumnRenamed("poi_id", "_poi"), F.col("p_partkey") == F.col("_poi"))
    if users is not None:
        own += [c for c in users.columns if c != "uid"]
        customer = customer.join(users.withColumnRenamed("uid", "_uid"), F.col("c_custkey") == F.col("_uid"))
    feature = lambda i, c: F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))
    # The searches are joined last: their key then deals the rows out, and grouping by it needs no further exchange.
    searches = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(searches, line.l_orderkey == orders.o_orderkey)
        .select(
            F.concat_ws("||", F.col("l_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("search_uid"),
            F.col("l_orderkey").alias("search_id"),
            F.col("o_custkey").alias("uid"),
            F.col("r_name").alias("country_code"),
            F.col("n_nationkey").alias("city_id"),
            F.col("o_orderdate").cast("date").alias("dt"),
            F.concat(
                F.date_format("o_orderdate", "yyyy-MM-dd"),
                F.lit(" "),
                F.lpad(F.pmod(F.col("l_orderkey"), F.lit(24)).cast("string"), 2, "0"),
                F.lit(":00:00"),
            ).alias("time_text"),
            F.when(F.col("o_orderstatus") == "F", 4).otherwise(1).alias("query_type"),
            F.concat_ws(" ", F.lower("o_orderpriority"), F.col("p_name")).alias("query"),
            F.col("l_partkey").alias("poi_id"),
            F.concat_ws("|", "p_name", "p_type").alias("name_address"),
            F.col("p_size").alias("layer"),
            F.col("p_brand").alias("category"),
            F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
            (F.col("l_linenumber") - 1).alias("show_pos"),
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("impression_id"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("score"),
            F.concat_ws(
                ";", feature(1, "l_quantity"), feature(2, "l_extendedprice"),
                feature(3, "l_discount"), feature(4, "l_tax"),
            ).alias("ltr_features"),
            F.col("l_linestatus").alias("line_status"),
            *own,
        )
    )


def order_label() -> Column:
    """Label of an impression in the order log."""
    return F.when((F.col("label") == 2) & (F.col("line_status") == "F"), 2).otherwise(F.least("label", F.lit(1)))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order log: the searches that finished in an order, with order labels."""
    im = impressions(spark, sf_dir)
    return im.where("query_type = 4").select(
        "search_uid", "search_id", "poi_id", "show_pos", "impression_id",
        F.lit("order").alias("data_type"),
        order_label().alias("label"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item corpus with coordinates."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("poi_id"),
        F.concat_ws("|", "p_name", "p_type").alias("name_address"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("addr"),
        F.pmod("p_partkey", F.lit(25)).cast("int").alias("city_id"),
        F.col("p_size").alias("layer"),
        F.col("p_brand").alias("category"),
        (F.pmod(F.col("p_partkey") * 37, F.lit(17000)).cast("double") / 100 - 85).alias("lat"),
        (F.pmod(F.col("p_partkey") * 91, F.lit(35000)).cast("double") / 100 - 175).alias("lng"),
    )


def searchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query side: a user with coordinates and a city."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("uid"),
        F.col("c_nationkey").alias("city_id"),
        F.concat(F.lit("u"), F.lpad((key * 7919).cast("string"), 10, "0")).alias("uid_text"),
        (F.pmod(key * 53, F.lit(17000)).cast("double") / 100 - 85).alias("lat"),
        (F.pmod(key * 71, F.lit(35000)).cast("double") / 100 - 175).alias("lng"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval vectors; every fifth one plays the query, the others the corpus."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").alias("city_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.when(F.pmod("vec_id", F.lit(5)) == 0, "query").otherwise("doc").alias("doctype"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click table for profiling and the click model."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").alias("cid"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("isclk"),
        F.col("value").alias("dclk"),
        F.hour("ts").alias("hr"),
        F.to_date("ts").alias("dt"),
    )


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-style table with missing values and categorical columns."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("target"),
        F.col("c_mktsegment").alias("seg_cat"),
        F.when(F.pmod(key, F.lit(7)) != 0, F.col("c_nationkey")).alias("nation_cat"),
        F.when(F.pmod(key, F.lit(11)) != 0, F.col("c_acctbal")).alias("bal"),
        F.pmod(key, F.lit(13)).alias("ps_calc_01"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street addresses in the forms the clean-up rules deal with, one per line item."""
    n = F.col("l_partkey").cast("string")
    m = F.col("l_suppkey").cast("string")
    letter = F.substring("l_returnflag", 1, 1)
    form = F.pmod(F.col("l_orderkey"), F.lit(6))
    text = (
        F.when(form == 0, F.concat_ws(" ", F.lit("calle"), n, F.lower(letter), F.lit("# #"), m, F.lit("-"), F.col("l_linenumber")))
        .when(form == 1, F.concat_ws(" ", F.lit("av calle"), n, F.lit("sur")))
        .when(form == 2, F.concat_ws(" ", F.lit("no"), n, F.lit("centro numero"), m))
        .when(form == 3, F.concat_ws(" ", F.lit("carrera"), n, F.lower(letter), F.lit("- -"), m))
        .when(form == 4, F.concat_ws(" ", F.lit("av"), n, F.lit("n"), m, F.lit("sur")))
        .otherwise(F.concat_ws(" ", F.lit("diagonal n"), n, F.lit("-"), letter, F.lit("-"), m))
    )
    return table(spark, sf_dir, "lineitem").select(text.alias("address")).distinct()


def _hot_searches(im: DataFrame, line: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(impressions of ordinary searches, those of searches too large for one task or None)."""
    total = line.count()
    counts = line.groupBy(F.col("l_orderkey").alias("search_id")).count()
    # At most 1 / HOT_SHARE searches, so the driver can name them.
    hot = [r.search_id for r in counts.where(F.col("count") >= max(hot_rows, int(total * HOT_SHARE))).select("search_id").collect()]
    if not hot:
        return im, None
    return im.where(~F.col("search_id").isin(hot)), im.where(F.col("search_id").isin(hot))


def search_log(spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Wide log in its stored form: one line per result page of a search, with a JSON
    object for the query and a JSON array for the items.

    The rows of a search lie together after the joins, so they are numbered and gathered there;
    searches of ``hot_rows`` and more, if any, are numbered by a sort over several tasks."""
    im = impressions(spark, sf_dir)
    keys, order = ["search_id", "search_uid"], [F.col("show_pos"), F.col("impression_id")]
    ordinary, hot = _hot_searches(im, table(spark, sf_dir, "lineitem"), hot_rows)
    numbered = ordinary.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if hot is not None:
        numbered = numbered.unionByName(group_positions(hot, keys, order, "_at"))
    item = F.struct(
        F.col("show_pos").cast("string").alias("p_show_pos"),
        F.col("impression_id").alias("p_impression_id"),
        F.col("poi_id").cast("string").alias("p_poi_id"),
        F.col("name_address").alias("p_name_address"),
        F.col("category").alias("p_category"),
        F.col("layer").cast("string").alias("p_layer"),
        F.col("label").cast("string").alias("p_label"),
        F.col("ltr_features").alias("p_ltrfeatures"),
    )
    return (
        numbered.withColumn("page", F.floor((F.col("_at") - 1) / LOG_PAGE_ITEMS))
        .groupBy(*keys, "page")
        .agg(
            F.min(
                F.struct(
                    F.col("country_code"), F.trunc("dt", "month").alias("month"),
                    F.col("dt"), F.col("city_id"), F.col("uid"), F.col("query_type"), F.col("query"), F.col("time_text"),
                )
            ).alias("q"),
            F.sort_array(F.collect_list(F.struct(F.col("_at"), item.alias("item")))).alias("items"),
        )
        .select(
            F.col("search_uid").alias("search_key"),
            "page",
            F.to_json(
                F.struct(
                    F.col("q.query").alias("g_disp_query"),
                    F.col("q.city_id").cast("string").alias("g_disp_area"),
                    F.col("q.uid").cast("string").alias("g_uid"),
                    F.col("q.time_text").alias("g_timestamp"),
                    F.col("q.query_type").cast("string").alias("g_query_type"),
                )
            ).alias("query_info"),
            F.to_json(F.col("items.item")).alias("poi_info"),
            F.col("q.month").alias("dt"),
            F.col("q.country_code").alias("country_code"),
        )
    )
