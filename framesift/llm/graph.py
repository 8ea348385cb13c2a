"""Connected components of links between 64-bit nodes: alternating large-star and small-star steps, each cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_dir


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b), two long columns; the label is the least node that is reachable.

    Null ends and loops are dropped; links in both directions or repeated count once; no links give no rows."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    least = F.min("v").over(Window.partitionBy("u"))
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", least)
        small = small.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, cut(small.where("a <> b").distinct(), "links")
        drop_dir(links.sparkSession, old._cut_path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
