"""Connected components of an edge table by least labels and pointer jumping, all in DataFrames.

Each round a node takes the least label among its own and its neighbours', then the label of that label. Both sides of
every step are pre-aggregated per node, and each round is written to the shared checkpoint folder. Hot keys are cut:
the edges of a node with more than ``HOT`` go to as many parts as needed, and labels that many nodes have are looked up
once and sent to ``HANDS`` parts. It ends when no label changes, so it is exact whatever the components' size or shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


HOT = 10_000
HANDS = 16


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); the label is the least node of its component."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = settle(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct())
    first = both.groupBy("node").agg(F.min("other").alias("least"), F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts"))
    labels = settle(first.select("node", F.least("node", "least").alias("label"), "parts"))
    hot = settle(labels.where("parts > 1").select(F.col("node").alias("other"), "parts"))
    if hot.isEmpty():
        edges_at = both.withColumn("part", F.lit(0))
    else:
        edges_at = both.join(hot, "other", "left").select("node", "other", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    edges_at = settle(edges_at)
    while True:
        told = labels.select(F.col("node").alias("other"), "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        near = edges_at.join(told, ["other", "part"]).groupBy("node").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", "parts", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        named = stepped.select("label").distinct().join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        jump = named.select("label", "further", F.explode(F.sequence(F.lit(0), F.lit(HANDS - 1))).alias("hand"))
        jumped = stepped.withColumn("hand", F.pmod(F.xxhash64("node"), F.lit(HANDS)).cast("int")).join(jump, ["label", "hand"])
        jumped = settle(jumped.select("node", "was", F.least("label", "further").alias("label"), "parts"))
        labels = jumped.select("node", "label", "parts")
        if jumped.where("was <> label").isEmpty():
            return labels.select("node", "label")
