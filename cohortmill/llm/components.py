"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of a link.

    Each round points every node to the smallest of its neighbours and itself, follows the pointers to their ends, and
    contracts the links to these; at least half of the nodes go in a round, and the smallest of a component is what
    remains. Links of a node to itself and repeated links change nothing.
    """
    edges = cut_lineage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("old"), F.least("u", "v").alias("mid"))
        step = cut_lineage(least.select("old", F.col("mid").alias("new")))
        moved = True
        while moved:  # pointers lead to smaller nodes, so following them ends at a node that is its own; each turn doubles the way
            onward = step.select(F.col("old").alias("new"), F.col("new").alias("next"))
            step = cut_lineage(step.join(onward, "new").select("old", F.col("next").alias("new"), (F.col("next") != F.col("new")).alias("moved")))
            moved = not step.where("moved").isEmpty()
            step = step.drop("moved")
        labels = cut_lineage(labels.join(step, labels["component"] == step["old"], "left")
                             .select("node", F.coalesce("new", "component").alias("component")))
        heads, tails = step.select(F.col("old").alias("u"), F.col("new").alias("x")), step.select(F.col("old").alias("v"), F.col("new").alias("y"))
        edges = cut_lineage(edges.join(heads, "u").join(tails, "v").where("x <> y")
                            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    return labels
