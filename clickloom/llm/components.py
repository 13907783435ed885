"""Connected components of an edge table: least labels passed to neighbours, with pointer jumping.

Labels live in a written table per round, so plans stay short and a lost executor costs a re-read. A node
of high degree is aggregated on the map side before its labels move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges`` (a, b); the component is its smallest node.

    Loops and repeated edges do no harm, edges with a missing end are left out, no edges give no rows.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = write_table(known.union(known.select("b", "a")).distinct(), "edges")
    labels = write_table(
        both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels"
    )
    while True:
        offered = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("offer"))
        )
        lower = labels.join(offered, labels["node"] == offered["a"], "left").select(
            "node", F.col("component").alias("before"), F.least("component", "offer").alias("component")
        )
        staged = write_table(lower, "labels")
        above = staged.select(F.col("node").alias("up"), F.col("component").alias("jump"))
        jumped = staged.join(above, staged["component"] == above["up"], "left").select(
            "node", "before", F.least("component", "jump").alias("component")
        )
        labels = write_table(jumped, "labels")
        if labels.where("before <> component").isEmpty():
            return labels.select("node", "component")
