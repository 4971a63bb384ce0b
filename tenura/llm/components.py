"""Connected components of an edge list, by least-neighbour hooking and pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of `edges` (a, b): comp is the least node that can be reached.

    Each round takes the least label among neighbours, then the label's own label; its labels are written to the shared
    folder, so lineage stays short. Rounds end when none changes a label: about the logarithm of the longest path. A
    component's nodes are dealt over several tasks when they look up their label's label, so a giant one is no hot key.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "comp": "m"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        hooked = written(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "hooked")
        if hooked.where("old <> comp").isEmpty():
            return labels
        ahead = hooked.where("comp <> node").select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        ahead = ahead.join(hooked.select("comp").distinct(), "comp")
        labels = written(looked_up(hooked, ahead, ["comp"], "node").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
