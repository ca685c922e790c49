"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark import session
from rankspark.operators import skew


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the label is the smallest node it reaches.

    Large-star and small-star steps alternate until the edges no longer change; each step is two
    grouped minima and joins, written to the shared folder, so nothing passes through the driver
    but a count and a checksum. The minima are written before they are joined, so that a hub with many
    links is split. Links of a node with itself count for nothing; null ends and an empty table give no rows.
    """
    edges = session.materialise(
        links.where(F.col("a") != F.col("b"))  # drops null ends as well
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = skew.attach(both, least, ["u"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = session.materialise(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew.attach(large, least, ["u"]).select(
            F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")),
            )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = session.materialise(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
