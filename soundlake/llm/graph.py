"""Connected components by alternating star steps; every step is joins and grouped minima, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import cut


def _hang(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) are hung on its least neighbour."""
    if both_ways:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # the minima are a table of their own, so that the join can split a node with very many neighbours
    low = cut(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
    if both_ways:
        out = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = around.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            low.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (columns u, v of one ordered type)."""
    now = cut(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = cut(_hang(cut(_hang(now, True)), False))
        after = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
