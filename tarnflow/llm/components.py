"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; ``root`` is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that
    label, so paths halve; rounds go on until no label changes. Every round is
    written to the shared folder, which keeps plans short and survives lost executors.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).union(links.select(F.col(b), F.col(a))).distinct()
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    table = labels
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select("node", "root", F.least("root", "near").alias("next"))
        step = materialize(nearer, "labels")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        jumped = step.join(jump, step["next"] == jump["at"]).select("node", F.least("next", "beyond").alias("root"), (F.least("next", "beyond") != F.col("root")).alias("moved"))
        done = materialize(jumped, "labels")
        moved = not done.where("moved").isEmpty()
        discard(step, table)
        labels, table = done.select("node", "root"), done
        labels.written_to = done.written_to
        if not moved:
            discard(edges)
            return labels
