"""Connected components of a link table by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, comp)``: for each node with a link, the smallest node it is linked to by any path.

    Each round lowers every label to the least among the neighbours' labels and then to the label of that label, and is
    written to the shared folder. Rounds needed grow as the logarithm of the longest path for chains, and a star takes
    one. Duplicate links, both directions and self-links are allowed; no links give no rows.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), "comp")
        least = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(least, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("jump"))
        new = keep(low.join(up, "low").select("node", F.least("low", "jump").alias("comp"), (F.least("low", "jump") < F.col("comp")).alias("moved")), "labels")
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels
