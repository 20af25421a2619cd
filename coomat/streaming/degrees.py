"""Out-degrees of a growing edge list.

Each file of edge-list text that arrives in a folder adds to the degrees; the state is one count a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coomat.sources.graph import parse_edges


def stream_edges(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(src, dst) of every line of every file that appears in ``folder``."""
    return parse_edges(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder))


def stream_out_degree(edges: DataFrame) -> DataFrame:
    """(node, deg), for output mode complete or update."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
