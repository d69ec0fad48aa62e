"""Connected components of an edge table, by label propagation with pointer jumping.

Every node takes the least label among its own and its neighbours', then the label of its label, until nothing
changes. Labels are written to the shared folder after each round, so neither lineage nor driver memory grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the label is the least node of its component."""
    both = stored(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = stored(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        new = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        new = new.join(new.select(F.col("node").alias("_of"), F.col("label").alias("_next")), F.col("label") == F.col("_of"))
        new = stored(new.select("node", "_old", F.least("label", "_next").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("_old <> label").take(1):
            return labels
