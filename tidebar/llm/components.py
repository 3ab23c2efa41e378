"""Connected components of a table of links: least labels and pointer jumping, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, discard, renamed


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the least node reachable, for every node that has a link.

    Links with a null end are left out, self links keep their node, repeated links change nothing. Each round joins the
    links with the labels of their far ends, takes the least per node (summed map-side first, so that a
    hub costs one row a task) and jumps to the label's own label; rounds grow with the logarithm of the diameter.
    """
    links = links.select("a", "b").na.drop()
    both = cut(links.union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        fresh = step.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("far", "component")).alias("component"))
        seen = Observation()
        fresh = cut(fresh, seen, F.count_if(F.col("was") != F.col("component")).alias("changed"))
        discard(labels)
        labels = renamed(fresh, node="node", component="component")
        if not seen.get["changed"]:
            discard(both)
            return labels
