"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), of any order and with repeats -> (node, component): component is the smallest node reachable.

    A large star links every larger neighbour of a node to the node's least neighbour, a small star every smaller one;
    the pair of steps ends, after about log(diameter) rounds, in stars around each component's least node. Nodes
    without edges are not returned. Hot nodes only ever meet in a min with partial aggregation and a join that AQE can
    split."""
    now, same = Staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = _directed(now.df)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Staged(large.where("u <> v").distinct())
        # small star: of each node's smaller neighbours, and itself, the least becomes the centre of all others
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        nxt = Staged(small.where("u <> v").distinct())
        before, same = same, nxt.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        large.drop()
        now.drop()
        now = nxt
        if before == same or not same[0]:
            break
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after further edges(u, v): only the components that these touch are worked on."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    new = Staged(components(between)).df
    old = comps.join(new.toDF("component", "joined"), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    return old.union(new.join(comps.select("node"), "node", "left_anti"))
