"""Connected components with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm.skew import Heavy, lookup


def connected_components(edges: DataFrame, a: str, b: str, keep: storage.Scratch | None = None) -> DataFrame:
    """(node, component) of the undirected graph; the component is named by its smallest node.

    Rounds of neighbour minimum and pointer jumping, each written to the shared folder. Edges with a
    null end are ignored; loops name their node. Nodes with very many edges and components with very many nodes are
    dealt over several tasks. Only a count of changed labels reaches the driver. The result's table is noted in ``keep``.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null")
    both = pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
    n = 2 * edges.count()
    scratch = storage.Scratch()
    links = scratch.cut(both.distinct(), n)
    hubs = Heavy(links, ["other"], n)
    step = storage.cut(links.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), n)
    while True:
        labels = step.select("node", "component")
        of_other = labels.select(F.col("node").alias("other"), F.col("component").alias("seen"))
        near = hubs.join(links, of_other, "node").groupBy("node").agg(F.min("seen").alias("near"))
        moved = scratch.cut(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid")), n)
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        last, step = step, storage.cut(lookup(moved, jump, "mid", "node", n, "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), n)
        storage.drop(last)
        if not step.where("old <> component").limit(1).count():
            scratch.close()
            if keep is not None:
                keep.tables.append(step)
            return step.select("node", "component")


def extended(labels: DataFrame, edges: DataFrame, n: int, keep: storage.Scratch) -> DataFrame:
    """``labels`` (node, component) after edges (a, b) were added; only components and nodes at the ends of edges are visited again."""
    named = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    ends = lookup(edges, named, "a", "b", n, "left").select(F.coalesce("x", "a").alias("a"), "b")
    named = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    ends = keep.cut(lookup(ends, named, "b", "a", n, "left").select("a", F.coalesce("y", "b").alias("b")).distinct(), n)
    moved = connected_components(ends, "a", "b", keep)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = lookup(labels, to, "component", "node", n, "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep.cut(old.unionByName(moved.join(labels.select("node"), "node", "left_anti").select("node", "component")), n)
