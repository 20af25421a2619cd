"""Connected components of a graph given as links, by label propagation with pointer jumping.

All steps are joins and grouped minima on Spark; nothing but one count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coomat.llm.tables import compact


def components(links: DataFrame) -> DataFrame:
    """(a bigint, b bigint) -> (node, label): label is the smallest node of the component.

    Nodes without links are not listed.  Repeated links, self links and either direction are fine; null ends are
    dropped; an empty table gives an empty one.
    """
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = compact(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = compact(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("next"), F.col("label").alias("was"))
        parents = labels.select(F.col("node").alias("next"), F.col("label").alias("top"))
        jumped = compact(stepped.join(parents, "next").select("node", F.least("next", "top").alias("label"), (F.least("next", "top") < F.col("was")).alias("moved")))
        if jumped.filter("moved").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
