"""Edge-list text and the graph made of it.

A line counts unless it is empty or its first character is ``#``.  It must start with two integers, with any white
space around the first (or none, where a sign parts them); the rest of the line is ignored, and so is a line that has
no two integers.  Ids start at 0 or 1: at 1 if the smallest id of all is at least 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coomat.operators.matrix import Matrix, span

#: Fixed pattern: possessive digits, so that one number can't be read as two.
EDGE = r"^\s*([+-]?\d++)\s*([+-]?\d++)"


def parse_edges(lines: DataFrame) -> DataFrame:
    """(value) -> (src, dst), raw ids."""
    kept = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    number = lambda k: F.expr(f"try_cast(regexp_extract(value, r'{EDGE}', {k}) as bigint)")
    return kept.select(number(1).alias("src"), number(2).alias("dst")).filter("src is not null and dst is not null")


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n: int

    @classmethod
    def of(cls, edges: DataFrame, base: int | None = None, n: int | None = None) -> Graph:
        """From raw ids.  One pass finds smallest and largest id; the node count is the largest plus one, gaps included."""
        edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
        low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if low is None:
            raise ValueError("no edges")
        base = base if base is not None else int(low >= 1)
        if low - base < 0:
            raise ValueError(f"id {low} lies before the first id, {base}")
        if base:
            edges = edges.select((F.col("src") - base).alias("src"), (F.col("dst") - base).alias("dst"))
        return cls(edges, max(high - base + 1, n or 0))

    def nodes(self) -> DataFrame:
        return span(self.edges.sparkSession, self.n, "node")

    def out_degree(self) -> DataFrame:
        """(node, deg) of nodes with edges; parallel edges count each."""
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))

    def in_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("deg"))

    def dangling(self) -> DataFrame:
        """Nodes without edges out."""
        return self.nodes().join(self.edges.select(F.col("src").alias("node")), "node", "left_anti")

    def transition(self) -> Matrix:
        """(i = dst, j = src): the share of src's edges that go to dst.  Parallel edges are summed before the join."""
        cells = self.edges.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("c"))
        shares = cells.join(self.out_degree().withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("i"), F.col("src").alias("j"), (F.col("c") / F.col("deg")).alias("v"))
        return Matrix(shares, self.n, self.n)


def read_snap(spark: SparkSession, path: str, base: int | None = None) -> Graph:
    """A graph from edge-list text; a missing path is Spark's PATH_NOT_FOUND."""
    return Graph.of(parse_edges(spark.read.text(path)), base)


def dataset_name(path: str) -> str:
    """The last part of a path without its last extension."""
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[0] or name
