"""Metrics files: one row for each run of an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed columns and types of the files, in order.
COLUMNS = (
    ("engine", "string"), ("dataset", "string"), ("num_nodes", "bigint"), ("num_edges", "bigint"), ("csr_nnz", "bigint"), ("mpi_ranks", "int"), ("omp_threads", "int"),
    ("damping", "double"), ("tol", "double"), ("iterations", "int"), ("converged", "string"), ("final_error", "double"), ("load_time_s", "double"), ("total_time_s", "double"),
    ("spmv_time_s", "double"), ("comm_time_s", "double"), ("comp_time_s", "double"), ("damp_time_s", "double"), ("comm_pct", "double"), ("comp_pct", "double"),
    ("avg_spmv_ms", "double"), ("avg_comm_ms", "double"), ("avg_comp_ms", "double"), ("mem_before_kb", "bigint"), ("mem_after_kb", "bigint"), ("mem_peak_rss_kb", "bigint"),
    ("l1_vs_ref", "double"), ("top10_match", "int"),
)
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)


def metrics_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n, _ in COLUMNS) for r in rows], SCHEMA)


def write_metrics(rows: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics(spark: SparkSession, folder: str, tag: str | None = None) -> DataFrame:
    """All metrics files of a folder, but no summaries; with a tag, as column _ds."""
    rows = spark.read.schema(SCHEMA).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = rows.filter(~name.contains("summary"))
    return rows if tag is None else rows.withColumn("_ds", F.lit(tag))


def read_tagged(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    out = None
    for tag, folder in folders.items():
        part = read_metrics(spark, folder, tag)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no folders")
    return out
