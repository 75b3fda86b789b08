"""Connected components of an edge table, in Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that occurs in
    ``edges(a, b)``. Smallest labels spread along edges and then jump to
    their label's label, so the rounds grow with the logarithm of the
    longest path; each round's labels are staged in the shared folder."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("id"))
                   .agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"),
                                              F.least("component", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("component").alias("next"))
        new = stage(step.join(jump, "label").select("id", "old", F.least("label", "next").alias("component")), "labels")
        if new.where("component <> old").limit(1).count() == 0:
            return new.select("id", "component")
        labels = new.select("id", "component")
