"""Vector retrieval checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.catalog.registry import check
from rankspark.operators import cells, metrics, retrieval
from rankspark.sources import tables

SQL_COS = "round(list_cosine_similarity(q.embedding, i.embedding), 6)"


def sides(spark, d):
    """Unit vectors of the query side (with its city) and of the corpus."""
    v = tables.vectors(spark, d)
    city = F.col("city_id")
    queries = retrieval.unit(v.where("doctype = 'query'"), "vec_id", "query_id", "embedding", city)
    items = retrieval.unit(v.where("doctype = 'doc'"), "vec_id", "item_id", "embedding", city)
    return queries, items


SQL_SIDES = """
q AS (SELECT vec_id, city_id, embedding FROM vectors WHERE doctype = 'query'),
i AS (SELECT vec_id, city_id, embedding FROM vectors WHERE doctype = 'doc')"""


def sql_exact(k: int) -> str:
    return f"""{SQL_SIDES},
exact AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, {SQL_COS} AS score FROM q, i
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {SQL_COS} DESC, i.vec_id) <= {k}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM exact)"""


@check("knn_exact", "vectors", f"WITH {sql_exact(10)} SELECT query_id, item_id, score, rank FROM ranked")
def knn_exact(spark, d):
    queries, items = sides(spark, d)
    return retrieval.exact_top_k(queries, items, 10)


# Queries of cities 0 to 2 ask in one that has no items, so they go to the default city 5.
SQL_CITY = f"""{SQL_SIDES},
ci AS (SELECT * FROM i),
cq AS (SELECT vec_id, embedding, CASE WHEN city_id >= 3 THEN city_id ELSE 5 END AS city_id FROM q)"""


def sql_city(k: int, extra: str = "true") -> str:
    return f"""{SQL_CITY},
found AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, {SQL_COS} AS score FROM cq q JOIN ci i ON q.city_id = i.city_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {SQL_COS} DESC, i.vec_id) <= {k}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM found)"""


def city_sides(spark, d):
    queries, items = sides(spark, d)
    city = F.when(F.col("city_id") < 3, -1).otherwise(F.col("city_id"))
    return retrieval.route_to_city(queries.withColumn("city_id", city), items, default_city=5), items


@check("knn_by_partition", "vectors", f"WITH {sql_city(31)} SELECT query_id, item_id, score, rank FROM ranked")
def knn_by_partition(spark, d):
    queries, items = city_sides(spark, d)
    return retrieval.city_top_k(queries, items, 31)


@check("knn_lsh")
def knn_lsh(spark, d):
    queries, items = sides(spark, d)
    return retrieval.compressed_top_k(queries, items, 10)


@check("knn_append", "vectors", f"WITH {sql_exact(5)} SELECT query_id, item_id, score, rank FROM ranked")
def knn_append(spark, d):
    queries, items = sides(spark, d)
    index = cells.append(cells.build(items.where("city_id < 6").select("item_id", "vector")), items.where("city_id >= 6").select("item_id", "vector"))
    return cells.search(queries.select("query_id", "vector"), index, 5)


# The clicked item of a query is the one that follows it by id.
@check("hard_negatives", "vectors", f"""
WITH {sql_city(31)},
kept AS (SELECT query_id, item_id, score FROM ranked WHERE item_id <> query_id + 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS INT) AS rank FROM kept)
SELECT query_id, item_id, score, rank, CASE WHEN rank BETWEEN 7 AND 12 THEN 0 ELSE 1 END AS part FROM r WHERE rank < 30""")
def hard_negatives(spark, d):
    queries, items = city_sides(spark, d)
    clicked = queries.select("query_id", (F.col("query_id") + 1).alias("item_id"))
    return retrieval.hard_negatives(queries, items, clicked, 30)


SQL_TEXTS = """
qt AS (SELECT vec_id AS query_id, string_split(p_name, ' ')[2] AS query FROM vectors JOIN part ON p_partkey = vec_id),
it AS (SELECT vec_id AS item_id, p_name AS name FROM vectors JOIN part ON p_partkey = vec_id)"""


@check("recall_at_k", "vectors", f"""
WITH {sql_exact(10)}, {SQL_TEXTS},
h AS (SELECT q.vec_id AS query_id, max(CASE WHEN item_id = q.vec_id + 1 THEN rank END) AS hit, max(CASE WHEN contains(name, query) THEN 1 ELSE 0 END) AS inside
  FROM q JOIN i l ON l.vec_id = q.vec_id + 1 LEFT JOIN ranked ON ranked.query_id = q.vec_id LEFT JOIN qt USING (query_id) LEFT JOIN it USING (item_id) GROUP BY q.vec_id)
SELECT 'rank_' || r AS measure, count(*) FILTER (hit = r) AS n FROM h, (SELECT unnest(range(1, 11)) AS r) GROUP BY r
UNION ALL SELECT 'recalled', count(hit) FROM h UNION ALL SELECT 'contained', count(*) FILTER (inside = 1) FROM h
UNION ALL SELECT 'recalled_or_contained', count(*) FILTER (hit IS NOT NULL OR inside = 1) FROM h
UNION ALL SELECT 'total', count(*) FROM h""")
def recall_at_k(spark, d):
    queries, items = sides(spark, d)
    part = tables.table(spark, d, "part")
    labelled = queries.select("query_id", (F.col("query_id") + 1).alias("label_item"))
    labelled = labelled.join(items.select(F.col("item_id").alias("label_item")), "label_item", "left_semi")
    query_text = part.select(F.col("p_partkey").alias("query_id"), F.get(F.split("p_name", " "), 1).alias("query"))
    names = part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    found = retrieval.exact_top_k(queries, items, 10)
    return metrics.recall_at(found, labelled.join(query_text, "query_id", "left"), names, 10)


@check("click_ratio_at_k", "vectors", f"""
WITH {sql_city(31)},
h AS (SELECT q.vec_id AS query_id, max(CASE WHEN item_id = q.vec_id + 1 THEN rank END) AS hit FROM q LEFT JOIN ranked ON ranked.query_id = q.vec_id GROUP BY q.vec_id)
SELECT count(*) AS total, round(count(*) FILTER (hit <= 1) / count(*), 6) AS top1, round(count(*) FILTER (hit <= 3) / count(*), 6) AS top3,
  round(count(*) FILTER (hit <= 5) / count(*), 6) AS top5, round(count(*) FILTER (hit <= 10) / count(*), 6) AS top10 FROM h""")
def click_ratio_at_k(spark, d):
    queries, items = city_sides(spark, d)
    clicked = queries.select("query_id", (F.col("query_id") + 1).alias("item_id"))
    return metrics.click_ratios(retrieval.city_top_k(queries, items, 31), clicked)


# Query, following item, and the item after that as the negative.
SQL_TRIPLETS = """
t AS (SELECT 1 - list_cosine_similarity(a.embedding, p.embedding) AS dp, 1 - list_cosine_similarity(a.embedding, n.embedding) AS dn
  FROM vectors a JOIN vectors p ON p.vec_id = a.vec_id + 1 JOIN vectors n ON n.vec_id = a.vec_id + 2 WHERE a.doctype = 'query')"""


@check("triplet_loss", "vectors", f"WITH {SQL_TRIPLETS} SELECT round(avg(greatest(dp - dn + 0.2, 0)), 6) AS loss FROM t")
def triplet_loss(spark, d):
    v = tables.vectors(spark, d)
    at = lambda shift, name: v.select((F.col("vec_id") - shift).alias("vec_id"), F.col("embedding").alias(name))
    t = v.where("doctype = 'query'").join(at(1, "positive"), "vec_id").join(at(2, "negative"), "vec_id")
    loss = metrics.triplet_loss(t, F.col("embedding"), F.col("positive"), F.col("negative"))
    return loss.select(F.round("loss", 6).alias("loss"))
