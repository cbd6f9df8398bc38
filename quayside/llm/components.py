"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b): root is the smallest reachable node.

    Each round every node takes the smallest label among its own, its neighbours' and
    its label's label, and hooks its former label onto it, so the number of rounds grows
    with the logarithm of a component's diameter. Labels are written each round, and those
    of the round before go.
    An empty table gives no rows; self loops and repeated edges do no harm.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        # What each node hears: its neighbours' labels, for itself and for its label.
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        own = labels.join(heard, labels.node == heard.a).select("node", "root", F.least("root", "m").alias("m"))
        hooks = own.select("node", "m").unionByName(own.where("m < root").select(F.col("root").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("root"))
        # A label's own label; labels repeat, so each is looked up once.
        jump = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stored(hooks.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = after.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
