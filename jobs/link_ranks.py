"""Ranks of the pages of a crawl that grows: an incremental job.

    python -m jobs.link_ranks --config jobs/link_ranks.json --pages PATH --output PATH --checkpoint PATH

1. A file stream takes the Parquet files of pages that no earlier run has taken (the checkpoint knows which), finds the
   links of every page and appends them to ``output/links``, partitioned by the suffix of the page's host.
2. PageRank runs over all links there are, and ``output/ranks`` is written anew, partitioned by suffix: host, path,
   rank, links_out, links_in.

A node is host and path; queries and fragments are cut off.  A page that comes again adds the links it didn't have; equal
links of one page count once.  Relative links start at the page's folder (dot segments are kept as they are); links of
other schemes than http and https are left out; pages with a null url, or one without ``://``, are no nodes.

A run that is broken off is repeated: the stream goes on from its checkpoint, files are taken once, and ranks depend on
the links alone.  A run without new files gives the same ranks again.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coomat.operators.pagerank import pagerank
from coomat.operators.partition import dense_ids
from coomat.session import session, settled
from coomat.sources.graph import Graph

log = logging.getLogger("link_ranks")

LINKS = "host string, path string, to_host string, to_path string, suffix string"
RANKS = "host string, path string, rank double, links_out bigint, links_in bigint, suffix string"
#: Fixed patterns.  A page is split at its anchors first, so each piece is searched once.
ANCHOR = r"<[aA]\s"
HREF = r"^[^>]*?\bhref\s*=\s*[\"']?([^\"'>\s]+)"
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def place(rest: Column) -> tuple[Column, Column]:
    """Host and path of what follows ``//``; an empty path is ``/``."""
    bare = F.regexp_extract(rest, r"^[^?#]*", 0)
    path = F.regexp_extract(bare, r"^[^/]*(/.*)$", 1)
    return F.translate(F.regexp_extract(bare, r"^[^/]*", 0), UPPER, LOWER), F.when(path == "", "/").otherwise(path)


def links(pages: DataFrame) -> DataFrame:
    """(url, html) -> a row for each link, to_host and to_path null for a page without any.  Works on streams, too."""
    host, path = place(F.substring(F.col("url"), F.instr("url", "://") + 3, F.length("url")))
    own = pages.filter(F.instr("url", "://") > 0).select(host.alias("host"), path.alias("path"), "html").filter("host <> ''")
    pieces = F.split(F.coalesce("html", F.lit("")), ANCHOR)
    found = F.filter(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), lambda x: F.regexp_extract(x, HREF, 1)), lambda x: (x != "") & ~x.startswith("#"))
    to = own.select("host", "path", F.explode_outer(F.array_distinct(found)).alias("href"))
    absolute = F.regexp_replace("href", r"^(?:[hH][tT][tT][pP][sS]?:)?//", "")
    to_host, to_path = place(absolute)
    whole = F.col("href").rlike(r"^(?:[hH][tT][tT][pP][sS]?:)?//")
    bare = F.regexp_extract("href", r"^[^?#]*", 0)
    here = F.when(bare == "", F.col("path")).when(bare.startswith("/"), bare).otherwise(F.concat(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), bare))
    other = F.col("href").rlike(SCHEME) & ~whole
    to = to.select("host", "path", F.when(whole, to_host).when(~other, F.col("host")).alias("to_host"), F.when(whole, to_path).when(~other, here).alias("to_path"))
    named = to.select("host", "path", F.when(F.col("to_host") != "", F.col("to_host")).alias("to_host"), "to_path")
    return named.select("host", "path", "to_host", F.when(F.col("to_host").isNotNull(), F.col("to_path")).alias("to_path"), suffix(F.col("host")).alias("suffix"))


def suffix(host: Column) -> Column:
    """The last label of a host, ``_`` if it is empty."""
    last = F.regexp_extract(host, r"[^.]*$", 0)
    return F.when(last == "", "_").otherwise(last)


def as_glob(path: str) -> str:
    """The same path as a glob: a stream of files takes a single file only by one."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def take_new(spark: SparkSession, pages: str, output: str, checkpoint: str, files_a_batch: int) -> int:
    """Appends the links of new page files to output/links; how many pages were read."""
    schema = StructType([f for f in spark.read.parquet(pages).schema if f.name in ("url", "html")])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(as_glob(pages))
    # files of links are written by suffix; rows of one suffix may be many, so they stay in the tasks that read them
    sink = links(source).writeStream.partitionBy("suffix").option("checkpointLocation", f"{checkpoint}/links").outputMode("append").trigger(availableNow=True)
    query = sink.format("parquet").start(f"{output}/links")
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def ranks(found: DataFrame, steps: int, tolerance: float, damping: float, digits: int) -> DataFrame:
    """All links -> host, path, rank, links_out, links_in, suffix."""
    spark = found.sparkSession
    name = lambda h, p: F.concat(h, p)  # noqa: E731  # a path starts with a slash and a host has none: names are unique
    edges = settled(found.select(name("host", "path").alias("src"), name("to_host", "to_path").alias("dst")).distinct())
    ids, n = dense_ids(edges.select(F.col("src").alias("name")).unionAll(edges.select("dst")), "name")
    if not n:
        return spark.createDataFrame([], RANKS)
    ids = settled(ids)
    real = edges.filter("dst is not null").join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    graph = Graph(settled(real), n)
    done = pagerank(graph, damping=damping, max_iter=steps, tol=tolerance)
    log.info("%d nodes, %d links, %d steps, change %.3g", n, done.stats.num_edges, done.stats.iterations, done.stats.final_error)
    counted = done.ranks.join(graph.out_degree().toDF("node", "o"), "node", "left").join(graph.in_degree().toDF("node", "i"), "node", "left").join(ids, "node")
    host = F.regexp_extract("name", r"^[^/]*", 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return counted.select(host.alias("host"), F.expr("substring(name, length(regexp_extract(name, '^[^/]*', 0)) + 1)").alias("path"), F.round("rank", digits).alias("rank"), zero("o").alias("links_out"), zero("i").alias("links_in"), suffix(host).alias("suffix"))


def run(spark: SparkSession, pages: str, output: str, checkpoint: str, steps: int = 50, tolerance: float = 1e-8, damping: float = 0.85, digits: int = 12, files_a_batch: int = 1000) -> None:
    """One run; the result is in output/ranks."""
    read = take_new(spark, pages, output, checkpoint, files_a_batch)
    log.info("read %d new pages of %s", read, pages)
    out = ranks(spark.read.schema(LINKS).parquet(f"{output}/links"), steps, tolerance, damping, digits)
    out.repartition("suffix", F.pmod(F.xxhash64("host", "path"), F.lit(8))).write.mode("overwrite").partitionBy("suffix").parquet(f"{output}/ranks")
    log.info("wrote %d ranks to %s/ranks", spark.read.schema(RANKS).parquet(f"{output}/ranks").count(), output)


def result(spark: SparkSession, output: str) -> DataFrame:
    """What the last run wrote."""
    return spark.read.schema(RANKS).parquet(f"{output}/ranks")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="JSON with any of the other options", default=None)
    for name in ("pages", "output", "checkpoint"):
        parser.add_argument(f"--{name}")
    given = parser.parse_args(arguments)
    spark = session("link_ranks")
    try:
        lines = spark.read.text(given.config, wholetext=True).first() if given.config else None
        config = (json.loads(lines.value) if lines else {}) | {k: v for k in ("pages", "output", "checkpoint") if (v := getattr(given, k)) is not None}
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
