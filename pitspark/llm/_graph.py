"""Connected components as DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm._io import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node that ``links`` names, loops included.

    Every step groups by node with map-side minima, so a node of very many links stays one row of the
    grouped side; the links only ever shrink towards stars. Ids must not be null. An empty table gives none."""
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    last = None
    while True:
        both = e.union(e.select("v", "u")).where("u <> v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return nodes.join(e.groupBy("u").agg(F.min("v").alias("v")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        last = now
