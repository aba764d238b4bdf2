"""Connected components of an undirected graph given as edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.llm.common import BROADCAST_KEYS, materialize
from factlens.storage import drop_scratch, scratch_path, written


def components(edges: DataFrame) -> DataFrame:
    """For every node of ``edges(a, b)`` the smallest node that it reaches: (node, component).

    Each round takes the smallest label among a node's neighbours and then the label's own label, so that paths halve;
    rounds end when no label changes. Labels are written to the shared folder after each round, and those of the round
    before are removed. Few distinct labels are left of large components, so labels of labels are looked up among the distinct
    ones, broadcast if a count shows that they are few: the nodes of a giant component never meet in one task.
    """
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    path = scratch_path(spark, "labels")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), path)
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step_path, new_path = scratch_path(spark, "step"), scratch_path(spark, "labels")
        step = written(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("least")), step_path)
        own = step.select(F.col("node").alias("least"), F.col("least").alias("up")).join(step.select("least").distinct(), "least", "left_semi")
        own_path = scratch_path(spark, "own")
        own = written(own, own_path)
        own = F.broadcast(own) if own.count() <= BROADCAST_KEYS // 2 else own
        new = written(step.join(own, "least").select("node", F.col("component").alias("before"), F.col("up").alias("component")), new_path)
        changed = new.filter("before <> component").limit(1).count()
        for old in (path, step_path, own_path):
            drop_scratch(spark, old)
        labels, path = new.select("node", "component"), new_path
        if not changed:
            return labels
