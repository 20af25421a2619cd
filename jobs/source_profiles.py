"""Which sources of a corpus use the same words: a sparse matrix product over all texts.

    python -m jobs.source_profiles --config jobs/source_profiles.json --documents PATH --output PATH

Every language has a sparse matrix of sources by words, weighted by how often a source has the word and by how few
sources have it (log of sources over sources with the word; a word that all have weighs nothing), with rows of length
one.  Its product with its transpose is the similarity of each two sources.  All languages are blocks of one matrix, so
it is one product.

``output/similarity`` is written anew, partitioned by language: source, other (both ways, without itself), similarity.
Words are runs of other characters than white space, A-Z in lower case; a null or empty language or source is ``_``;
null texts have no words; pairs of sources that share no word of weight have no row.  Repeating a run gives the same.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coomat.operators.matrix import Matrix
from coomat.operators.multiply import matmul
from coomat.operators.partition import dense_ids
from coomat.session import session, settled

log = logging.getLogger("source_profiles")

SIMILARITY = "source string, other string, similarity double, lang string"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def named(column: str) -> Column:
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("_"))


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, word, n.  Words are counted as they are written, and only what differs is lower-cased."""
    written = documents.select(named("lang").alias("lang"), named("source").alias("source"), F.explode(F.split("text", SPACES)).alias("word")).filter("word <> ''")
    counts = written.groupBy("lang", "source", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("lang", "source", F.translate("word", UPPER, LOWER).alias("word")).agg(F.sum("n").alias("n"))


def weights(documents: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, word, v > 0; the squares of a source's v sum to 1."""
    counts = settled(word_counts(documents))
    sources = counts.select("lang", "source").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    spread = counts.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("with_word")).join(sources, "lang").filter("with_word < sources")
    rated = counts.join(spread, ["lang", "word"]).select("lang", "source", "word", (F.col("n") * F.log(F.col("sources") / F.col("with_word"))).alias("v"))
    lengths = rated.groupBy("lang", "source").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    return rated.join(lengths, ["lang", "source"]).select("lang", "source", "word", (F.col("v") / F.col("length")).alias("v"))


def similarity(documents: DataFrame, digits: int) -> DataFrame:
    """(lang, source, text) -> source, other, similarity, lang."""
    found = settled(weights(documents))
    row, column = F.concat_ws("\t", "lang", "source"), F.concat_ws("\t", "lang", "word")  # no word has a tab
    cells = found.select(row.alias("r"), column.alias("c"), "v")
    rows, n = dense_ids(cells, "r", "i")
    columns, m = dense_ids(cells, "c", "j")
    rows = settled(rows)
    matrix = Matrix(settled(cells.join(rows, "r").join(columns, "c").select("i", "j", "v")), n, m)
    alike = matmul(matrix, matrix.transpose()).df.filter("i <> j")
    log.info("%d sources by language, %d words by language", n, m)
    parts = F.split("r", "\t", 2)
    names = rows.select("i", parts[0].alias("lang"), parts[1].alias("source"))
    return alike.join(names, "i").join(names.select(F.col("i").alias("j"), F.col("source").alias("other")), "j").select("source", "other", F.round("v", digits).alias("similarity"), "lang")


def run(spark: SparkSession, documents: str, output: str, digits: int = 8) -> None:
    """One run; the result is in output/similarity."""
    docs = spark.read.parquet(documents).select("lang", "source", "text")
    log.info("read %d documents of %s", docs.count(), documents)
    similarity(docs, digits).repartition("lang", F.pmod(F.xxhash64("source"), F.lit(8))).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/similarity")
    log.info("wrote %d pairs to %s/similarity", result(spark, output).count(), output)


def result(spark: SparkSession, output: str) -> DataFrame:
    """What the last run wrote."""
    return spark.read.schema(SIMILARITY).parquet(f"{output}/similarity")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="JSON with any of the other options", default=None)
    for name in ("documents", "output"):
        parser.add_argument(f"--{name}")
    given = parser.parse_args(arguments)
    spark = session("source_profiles")
    try:
        lines = spark.read.text(given.config, wholetext=True).first() if given.config else None
        config = (json.loads(lines.value) if lines else {}) | {k: v for k in ("documents", "output") if (v := getattr(given, k)) is not None}
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
