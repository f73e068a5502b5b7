"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailwright.llm.session import table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: the label is the least node of its component.

    Each round takes the least label among neighbours and then that label's own label (pointer jumping); each
    round's labels are written to the shared folder.  ``edges`` is read three times: a stored table, best.  Minima are taken map-side, so a hub costs one row a task.
    """
    n = edges.count()
    few = lambda df, name: table(df, name, n, 100_000)
    both = few(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = few(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new
        labels = new
