"""Connected components of a table of links, as an iterated join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermend.workspace import discard, stored

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least node reachable over ``links(a, b)``, for every node that has a link.

    Each round takes the least label of a node and its neighbours and then the
    label of that label, so paths shorten by more than half; labels are written
    once a round.  Joins are on node numbers and aggregate with map-side
    combining, so a node with very many links doesn't meet in one task.  Rounds grow
    with the logarithm of the longest path; ``MAX_ROUNDS`` of them reach beyond any
    table, and more raise an error rather than give unsettled labels.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = stored(nearer.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        changed = not step.where("component < old").isEmpty()
        discard(written)
        written, labels = step, step.select("node", "component")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
