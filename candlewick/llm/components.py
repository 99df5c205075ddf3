"""Connected components of links between keys, by joins: no group and no key list meets in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import materialize, parts

SPARE = 16  # partitions of the session to one file of a table of links or labels


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), both long: root is the smallest node of its component.

    Each round hangs every node on the smallest root seen among its neighbours and then halves the way up
    (labels are replaced by their labels' labels), so the rounds grow with the logarithm of a component's
    length. A node with very many links costs a partial minimum, not a list. Labels are written to the
    shared folder each round, and those of the round before removed.
    """
    # rows of two numbers make few files; the joins before them run at the session's width
    few = max(1, parts(links.sparkSession) // SPARE)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both.repartition(few), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
    labels = materialize(labels.repartition(few), "labels")
    while True:
        # the smallest label of a node's neighbours goes to the node and to the root that it has now
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        own = labels.join(seen, "node")
        lower = own.where("near < root").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("via"))
        stepped = own.join(lower, "node", "left").select("node", F.least("root", "near", "via").alias("root"), F.col("root").alias("old"))
        up = stepped.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = stepped.join(up, "root").select("node", F.least("root", "top").alias("root"), (F.least("root", "top") < F.col("old")).alias("moved"))
        new = materialize(new.repartition(few), "labels", instead_of=labels)
        labels = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return labels
