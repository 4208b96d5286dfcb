"""Connected components as staged label rounds: no driver-side graph, no localCheckpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, ws: Workspace, name: str = "labels") -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is the least node of its component.

    Each round takes the least label among neighbours, then the label's own label (pointer jumping), so long chains
    halve. A round is one staged table; the loop ends when no label moved.
    """
    both = ws.stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{name}-edges")
    labels = ws.stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")).select("node", "label"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("label").alias("near"))
        lower = ws.stage(labels.join(near, F.col("node") == F.col("v")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), f"{name}-{step}-a")
        up = lower.select(F.col("node").alias("at"), F.col("label").alias("top"))
        moved = ws.stage(lower.join(up, F.col("label") == F.col("at")).select("node", F.col("top").alias("label"), (F.col("top") != F.col("was")).alias("moved")), f"{name}-{step}")
        labels = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return labels
