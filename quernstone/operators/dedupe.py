"""Exact and near deduplication, split leaks, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import cut


def exact_text(df: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """One row for each text: its smallest key, label and copies; texts with conflicting labels go altogether."""
    groups = df.groupBy(text).agg(F.min(key).alias(key), F.count_distinct(label).alias("_labels"), F.first(label, True).alias(label), F.count("*").alias("copies"))
    return groups.where("_labels <= 1").select(key, label, "copies")


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def split_leaks(df: DataFrame, norm: str, split: str, key: str, ranks: dict[str, int]) -> DataFrame:
    """A text stays in its split of the lowest rank only, once."""
    rank = F.coalesce(*[F.when(F.col(split) == s, r) for s, r in ranks.items()])
    return first_by(df.withColumn("_r", rank), [norm], ["_r", key]).drop("_r")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component. Labels spread along edges until no label changes; each round is cut from its past by a checkpoint where the session has a folder for it."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        jump = labels.select(F.col("u").alias("root"), F.col("root").alias("rr"))
        new = cut(labels.join(near, "u").join(jump, "root", "left").select("u", F.least("root", "r", F.coalesce("rr", "root")).alias("root"), F.col("root").alias("was")))
        if new.where("root <> was").isEmpty():
            return new.select(F.col("u").alias("node"), "root")
        labels = new.select("u", "root")


def greedy_keep(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Keys that a pass in key order keeps: a row goes if it is near a *kept* earlier row. Local minima are decided in
    rounds: kept once all earlier neighbours are dropped, dropped once one is kept."""
    pairs = cut(edges.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")).distinct())
    state = cut(nodes.select(F.col(key).alias("id"), F.lit(None).cast("boolean").alias("kept")))
    while True:
        seen = pairs.join(state.select(F.col("id").alias("early"), F.col("kept").alias("k")), "early").groupBy(F.col("late").alias("id"))
        seen = seen.agg(F.coalesce(F.max("k"), F.lit(False)).alias("near_kept"), (F.count("*") == F.count_if(~F.col("k"))).alias("all_dropped"))
        decided = F.coalesce("kept", F.when(F.col("near_kept"), False).when(F.col("all_dropped").isNull() | F.col("all_dropped"), True))
        state = cut(state.join(seen, "id", "left").select("id", decided.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            return state.where("kept").select("id")
