"""Connected components of an undirected graph, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_written, written


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, component): for each node of an edge the smallest node that it reaches.

    A round takes each node's smallest neighbouring label and then the label's
    own label, and that one's, so a chain of n nodes takes about log n rounds.  Labels never
    leave the executors; each round is a table in the shared folder.  Edges
    with a null end are left out; a self-loop makes its node known.
    """
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    links = edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("src"), b.alias("dst"))
    links = written(links.union(links.select("dst", "src")).distinct())
    labels = written(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = links.join(labels, links.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        nearest = labels.join(near, labels.node == near.src, "left").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        table = written(nearest)
        once, twice = (table.select(F.col("node").alias(f"at{i}"), F.col("component").alias(f"further{i}")) for i in (1, 2))
        jumped = table.join(once, table.component == once.at1, "left").join(twice, F.col("further1") == twice.at2, "left")
        after = written(jumped.select("node", "before", F.least("component", "further1", "further2").alias("component")))
        changed = not after.where("before <> component").isEmpty()
        drop_written(labels, table)
        labels = after
        if not changed:
            drop_written(links)
            return labels.select("node", "component")
