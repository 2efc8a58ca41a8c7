"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in the links a, b.

    Every node takes the smallest label among its neighbours and then the label of that label, until none changes, so
    chains shorten by more than half in each round.  Labels go through the shared folder after each round; only the
    number of changes reaches the driver.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                   .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m"))
                     .select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node")
                .agg(F.min("component").alias("m")))
        took = labels.join(near, "node").select("node", F.least("component", "m").alias("via"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = written(took.join(jump, "via").select("node", F.least("via", "far").alias("component"), "old"), "labels")
        if new.where("component < old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")
