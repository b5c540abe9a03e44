"""Connected components of an edge table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  Each node's neighbours, all or only the smaller ones, move to the smallest."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, root of every node that isn't its component's smallest.  edges: a, b (longs, no nulls)."""
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "component-edges")
    state = None
    while True:
        now = materialize(stars(stars(now, True), False), "component-edges")
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # one row
        if told == state:
            return now.select("a", F.col("b").alias("root"))
        state = told
