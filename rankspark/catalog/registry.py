"""Query registry: each check pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL text of the derived views, in dependency order.
VIEWS = {
    "impressions": """
SELECT concat_ws('||', CAST(l.l_orderkey AS STRING), CAST(o.o_custkey AS STRING)) AS search_uid,
  l.l_orderkey AS search_id, o.o_custkey AS uid, r.r_name AS country_code, n.n_nationkey AS city_id,
  CAST(o.o_orderdate AS DATE) AS dt,
  strftime(o.o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(l.l_orderkey % 24 AS STRING), 2, '0') || ':00:00' AS time_text,
  CASE o.o_orderstatus WHEN 'F' THEN 4 ELSE 1 END AS query_type,
  concat_ws(' ', lower(o.o_orderpriority), p.p_name) AS query,
  l.l_partkey AS poi_id, concat_ws('|', p.p_name, p.p_type) AS name_address,
  p.p_size AS layer, p.p_brand AS category,
  CASE l.l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
  l.l_linenumber - 1 AS show_pos,
  concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
    CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS impression_id,
  l.l_extendedprice * (1 - l.l_discount) / l.l_quantity AS score,
  concat_ws(';', '1:' || CAST(l.l_quantity AS STRING), '2:' || CAST(l.l_extendedprice AS STRING),
    '3:' || CAST(l.l_discount AS STRING), '4:' || CAST(l.l_tax AS STRING)) AS ltr_features,
  l.l_linestatus AS line_status, l.l_quantity AS f1, l.l_extendedprice AS f2, l.l_discount AS f3, l.l_tax AS f4
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "order_log": """
SELECT search_uid, search_id, poi_id, show_pos, impression_id, 'order' AS data_type,
  CASE WHEN label = 2 AND line_status = 'F' THEN 2 ELSE least(label, 1) END AS label
FROM impressions WHERE query_type = 4""",
    "places": """
SELECT p_partkey AS poi_id, concat_ws('|', p_name, p_type) AS name_address, p_name AS name, p_type AS addr,
  CAST(p_partkey % 25 AS INT) AS city_id, p_size AS layer, p_brand AS category,
  CAST((p_partkey * 37) % 17000 AS DOUBLE) / 100 - 85 AS lat,
  CAST((p_partkey * 91) % 35000 AS DOUBLE) / 100 - 175 AS lng
FROM part""",
    "searchers": """
SELECT c_custkey AS uid, c_nationkey AS city_id, 'u' || lpad(CAST(c_custkey * 7919 AS STRING), 10, '0') AS uid_text,
  CAST((c_custkey * 53) % 17000 AS DOUBLE) / 100 - 85 AS lat,
  CAST((c_custkey * 71) % 35000 AS DOUBLE) / 100 - 175 AS lng
FROM customer""",
    "vectors": """
SELECT vec_id, label AS city_id, CAST(embedding AS DOUBLE[]) AS embedding,
  CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'doc' END AS doctype
FROM embeddings""",
    "clicks": """
SELECT user_id, event_id AS cid, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS isclk,
  value AS dclk, CAST(extract(hour FROM ts) AS INT) AS hr, CAST(ts AS DATE) AS dt
FROM events""",
    "tabular": """
SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS target, c_mktsegment AS seg_cat,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS nation_cat,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS bal,
  c_custkey % 13 AS ps_calc_01
FROM customer""",
    "texts": "SELECT doc_id, lang, source, text FROM documents",
    "addresses": """
SELECT DISTINCT CASE l_orderkey % 6
  WHEN 0 THEN concat_ws(' ', 'calle', l_partkey, lower(l_returnflag), '# #', l_suppkey, '-', l_linenumber)
  WHEN 1 THEN concat_ws(' ', 'av calle', l_partkey, 'sur')
  WHEN 2 THEN concat_ws(' ', 'no', l_partkey, 'centro numero', l_suppkey)
  WHEN 3 THEN concat_ws(' ', 'carrera', l_partkey, lower(l_returnflag), '- -', l_suppkey)
  WHEN 4 THEN concat_ws(' ', 'av', l_partkey, 'n', l_suppkey, 'sur')
  ELSE concat_ws(' ', 'diagonal n', l_partkey, '-', l_returnflag, '-', l_suppkey) END AS address
FROM lineitem""",
}
NEEDS = {"order_log": ["impressions"]}


def with_views(views: str, body: str) -> str:
    """Put the named views in front of a statement as common table expressions."""
    names: list[str] = []
    for v in views.split():
        names += [d for d in NEEDS.get(v, []) if d not in names]
        names += [v] if v not in names else []
    body = body.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in names)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def check(name: str, views: str = "", sql: str | None = None):
    """Register a query under ``name``; ``sql`` is left out where SQL cannot say it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def ints(col: Column | str) -> Column:
    """Show an integer or text array as comma-separated text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(col.cast("array<string>"), ",")


def scaled_text(x: Column, digits: int = 4) -> Column:
    """A number as a whole multiple of 10^-digits."""
    # Most slots of a dense list are 0, and rounding goes by way of a decimal.
    return F.when(x == 0, "0").otherwise(F.round(x * 10**digits).cast("bigint").cast("string"))


def scaled(col: Column | str, digits: int = 4) -> Column:
    """Show a number array as comma-separated whole multiples of 10^-digits."""
    return F.array_join(F.transform(col, lambda x: scaled_text(x, digits)), ",")
