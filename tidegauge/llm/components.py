"""Roots of forests by pointer jumping, and components of link tables by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import written


def _stars(edges: DataFrame) -> DataFrame:
    """One contraction: all neighbours, then the smaller ones, move to the smallest."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.where("u <> v").distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u")
    return small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()


def tops(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) without cycles.

    Each round doubles the way that a pointer goes; it ends when no root has a parent.
    """
    roots = parents.select("node", F.col("parent").alias("root"))
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if roots.join(above, "root", "left_semi").isEmpty():
            return roots
        roots = written(roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v) but the roots; a root is its group's smallest node.

    Each round is written to the shared folder, so the plan stays short and a lost executor
    costs one round. It ends when a round changes no edge, however many that takes.
    """
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, edges = now, written(_stars(edges))
