"""Connected components of a graph of links, by alternating large and small stars.

Each step sends every node's neighbours to the smallest of them; the number of
links never grows and star-shaped groups settle after one or two turns. Links
live in tables of the shared folder between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return (moved.unionByName(least.select("u", F.col("least").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v: long); a component is its smallest node."""
    links = links.where(F.col("u") != F.col("v")).select("u", "v")
    before = None
    while True:
        links = cut(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    # settled: every link leads from a node to its component
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
