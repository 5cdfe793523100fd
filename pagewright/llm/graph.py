"""Connected components of an edge table, by min-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import stored


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b); the label is the least node of the component.

    With ``labels`` of earlier edges, only their components are joined by the new ones.
    Each round takes the least label of the neighbours, then the label of that label,
    so long chains shrink exponentially; only narrow rows move, and a hub's edges are
    pre-aggregated before its minimum is taken.
    """
    if labels is not None:
        for end in ("a", "b"):
            known = labels.select(F.col("node").alias(end), "label")
            edges = edges.join(known, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    found = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    while True:
        told = both.join(found.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), F.col("label").alias("mid"), F.lit(None).alias("old"))
        closer = told.unionByName(found.select("node", F.col("label").alias("mid"), F.col("label").alias("old"))).groupBy("node").agg(
            F.min("mid").alias("mid"), F.max("old").alias("old"))
        jump = found.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = stored(closer.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        found = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            break
    if labels is None:
        return found
    # Earlier components take the label of theirs; nodes that were alone come in.
    renamed = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select(
        "node", F.coalesce("new", "label").alias("label"))
    return stored(renamed.unionByName(found.join(labels.select("node"), "node", "left_anti")))
