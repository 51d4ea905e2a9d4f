"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Per node of ``edges`` (a, b): node, label, the smallest node reachable from it.

    Each round takes the smallest label among the neighbours, then the label of the label, so
    a chain of n nodes needs about log n rounds.  Every round is written to the shared folder;
    nothing is collected but the number of labels that changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = common.cut(both, "edges")
    files = common.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    labels = files
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = common.cut(low.join(jump, "low").select("node", F.least("low", "further").alias("next"), "label"), "labels")
        common.discard(files)
        changed = new.filter("next <> label").count()
        files, labels = new, new.select("node", F.col("next").alias("label"))
        if not changed:
            common.discard(both)
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
