"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.sources.scratch import discard, written


def components(links: DataFrame) -> DataFrame:
    """Links (a long, b long) -> (node, label); nodes without a link are left out.

    Every round sends each node to the smallest of itself and its neighbours and contracts the links.
    With ids that are hashes a round merges a fixed share of what is left, so the number of rounds
    grows with the logarithm of the longest chain. Each round ends in scratch tables. A label is one
    of the nodes of the component. Null ends and loops are ignored.
    """
    edges = written(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links"
    )
    labels = None
    while not edges.isEmpty():
        step = edges.groupBy(F.col("a").alias("from")).agg(F.least(F.col("from"), F.min("b")).alias("to"))
        step = written(step, "step")
        if labels is None:
            old, labels = None, written(step.select(F.col("from").alias("node"), F.col("to").alias("label")), "labels")
        else:
            moved = labels.join(step, F.col("label") == F.col("from"), "left")
            old, labels = labels, written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        here = edges.join(step.select(F.col("from").alias("a"), F.col("to").alias("a2")), "a")
        both = here.join(step.select(F.col("from").alias("b"), F.col("to").alias("b2")), "b")
        left = written(
            both.select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(),
            "links",
        )
        discard(edges, step, *([] if old is None else [old]))
        edges = left
    discard(edges)
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, label long")
    return labels
