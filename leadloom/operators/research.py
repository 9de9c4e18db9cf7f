"""Which pages of a site are read: its link graph level by level, then the best within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.html import relevance
from leadloom.operators.settle import settled


def levels(homes: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(site, url, anchor, depth) of all that is reached from the sites' home pages over at most `max_depth` links.

    `homes` has site and url, `edges` has site, url, link and anchor. A page is reached on its first level alone; of several
    anchors there the one that promises most counts, then the first in alphabetical order. One join for each level.
    """
    front = homes.select("site", "url", F.lit("home").alias("anchor"), F.lit(0).alias("depth")).dropDuplicates(["site", "url"])
    reached = settled(front)
    for depth in range(1, max_depth + 1):
        front = reached.filter(F.col("depth") == depth - 1).select("site", "url")
        found = edges.join(front, ["site", "url"]).select("site", F.col("link").alias("url"), F.coalesce("anchor", F.lit("")).alias("anchor"))
        best = found.groupBy("site", "url").agg(F.min_by("anchor", F.struct((-relevance(F.col("url"), F.col("anchor"))).alias("s"), "anchor")).alias("anchor"))
        new = best.join(reached.select("site", "url"), ["site", "url"], "left_anti")
        reached = settled(reached.unionByName(new.withColumn("depth", F.lit(depth))))
    return reached


def plan(reached: DataFrame, budget: int) -> DataFrame:
    """(site, url, depth, score, rank): the home page, then pages that promise anything, by score and address, `budget` in all for a site."""
    scored = reached.withColumn("score", relevance(F.col("url"), F.col("anchor"))).filter("depth = 0 OR score > 0")
    order = Window.partitionBy("site").orderBy(F.when(F.col("depth") == 0, 0).otherwise(1), F.desc("score"), "url")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget).select("site", "url", "depth", "score", "rank")
