"""Analyses of metrics rows: speed-up, grids, best configurations, shares, reports.

Rows carry the columns of ``coomat.sources.metrics`` and the dataset tag ``_ds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coomat.functions.scalars import fixed, ratio


def of_engine(rows: DataFrame, prefix: str, ranks: int | None = None, threads: int | None = None) -> DataFrame:
    kept = rows.filter(F.col("engine").startswith(prefix))
    for column, value in (("mpi_ranks", ranks), ("omp_threads", threads)):
        if value is not None:
            kept = kept.filter(F.col(column) == value)
    return kept


def speedup(rows: DataFrame, prefix: str, along: str = "mpi_ranks") -> DataFrame:
    """(_ds, along, total_time_s, speedup): against the run with 1 of ``along`` in the same dataset."""
    other = "omp_threads" if along == "mpi_ranks" else "mpi_ranks"
    own = rows.filter(F.col("engine").startswith(prefix) & (F.col(other) == 1)).groupBy("_ds", along).agg(F.min("total_time_s").alias("total_time_s"))
    base = own.filter(F.col(along) == 1).select("_ds", F.col("total_time_s").alias("t1"))
    return own.join(base, "_ds").select("_ds", along, "total_time_s", ratio(F.col("t1"), F.col("total_time_s")).alias("speedup"))


def setup(rows: DataFrame) -> DataFrame:
    """(_ds, num_nodes, num_edges, density_pct): the first row of each dataset by engine, ranks and threads."""
    first = rows.groupBy("_ds").agg(F.min_by(F.struct("num_nodes", "num_edges"), F.struct("engine", "mpi_ranks", "omp_threads")).alias("r")).select("_ds", "r.*")
    cells = F.col("num_nodes").cast("double") * F.col("num_nodes").cast("double")
    return first.withColumn("density_pct", ratio(F.col("num_edges").cast("double"), cells, 100.0))


def best_config(rows: DataFrame) -> DataFrame:
    """(_ds, engine, mpi_ranks, omp_threads, total_time_s): the fastest run with a positive time; ties by name and size."""
    run = F.struct("total_time_s", "engine", "mpi_ranks", "omp_threads")
    return rows.filter("total_time_s > 0").groupBy("_ds").agg(F.min(run).alias("r")).select("_ds", "r.engine", "r.mpi_ranks", "r.omp_threads", "r.total_time_s")


def grid(rows: DataFrame, prefix: str, threads: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """(_ds, mpi_ranks, t1, t2, t4): total time by ranks and threads."""
    own = rows.filter(F.col("engine").startswith(prefix))
    wide = own.groupBy("_ds", "mpi_ranks").pivot("omp_threads", list(threads)).agg(F.min("total_time_s"))
    return wide.select("_ds", "mpi_ranks", *(F.col(f"`{t}`").alias(f"t{t}") for t in threads))


def comm_share(rows: DataFrame) -> DataFrame:
    """Communication in per cent of communication and computation; runs that have neither are left out."""
    both = F.col("comm_time_s") + F.col("comp_time_s")
    return rows.filter(both > 0).select("_ds", "engine", "mpi_ranks", "omp_threads", (100 * F.col("comm_time_s") / both).alias("comm_share_pct"))


def memory(rows: DataFrame) -> DataFrame:
    """(_ds, rss_mb, dense_mb): what the serial sparse engine took, and what a dense matrix would take.

    The first run of CSR_Serial by ranks and threads counts, as other engines share their memory with other processes.
    """
    n = F.col("num_nodes").cast("double")
    serial = rows.filter(F.col("engine").startswith("CSR_Serial"))
    one = serial.groupBy("_ds").agg(F.min_by(F.struct(F.col("mem_peak_rss_kb").alias("kb"), n.alias("n")), F.struct("mpi_ranks", "omp_threads", "engine")).alias("r")).select("_ds", "r.*")
    return one.select("_ds", (F.col("kb") / 1024).alias("rss_mb"), (F.col("n") * F.col("n") * 8 / (1024.0 * 1024.0)).alias("dense_mb"))


#: The orders of result files: by engine, by size of the run, and by time.
ORDERS = {"engine": ("engine", "mpi_ranks", "omp_threads"), "size": ("mpi_ranks", "omp_threads", "engine"), "time": ("total_time_s", "engine", "mpi_ranks", "omp_threads")}


def ordered(rows: DataFrame, by: str = "engine") -> DataFrame:
    return rows.orderBy(*ORDERS[by])


def merged(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Columns of the report, in order; those of numbers with fixed digits.
SHOWN = ("dataset", "mpi_ranks", "omp_threads", "num_nodes", "num_edges", "iterations", "converged", "total_time_s", "spmv_time_s", "avg_spmv_ms", "comm_pct", "comp_pct", "mem_peak_rss_kb", "l1_vs_ref")
DIGITS = ("total_time_s", "spmv_time_s", "avg_spmv_ms", "comm_pct", "comp_pct")


def shown(rows: DataFrame, columns: tuple[str, ...] = SHOWN) -> DataFrame:
    """Columns as the report has them: texts, fixed digits for numbers, a dash for what is not there."""
    there = [c if c in rows.columns else None for c in columns]
    return rows.select(*(F.lit("-").alias(c) if own is None else F.coalesce(fixed(c) if c in DIGITS else F.col(c).cast("string"), F.lit("-")).alias(c) for c, own in zip(columns, there, strict=True)))


def _table(rows: DataFrame, columns: tuple[str, ...]) -> list[str]:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return head + ["| " + " | ".join(r) + " |" for r in shown(rows, columns).toLocalIterator()]


def report(rows: DataFrame, title: str = "Results") -> str:
    """A Markdown report: a table for each engine, and one of all runs by time; rows are metrics, which are few."""
    lines = [f"# {title}"]
    for r in rows.select("engine").distinct().orderBy("engine").collect():
        lines += ["", f"## {r.engine}", "", *_table(ordered(rows.filter(F.col("engine") == r.engine), "size"), SHOWN)]
    return "\n".join([*lines, "", "## All runs", "", *_table(ordered(rows, "time"), ("engine", *SHOWN[:3], "iterations", "total_time_s"))]) + "\n"


def terminal(rows: DataFrame) -> str:
    """All runs as lines of text, fastest first."""
    shown = ordered(rows, "time").select("engine", "mpi_ranks", "omp_threads", "total_time_s").toLocalIterator()
    return "\n".join(f"{r.engine:<24}{r.mpi_ranks:>5}{r.omp_threads:>5}{r.total_time_s:>12.4f} s" for r in shown)


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("_ds").orderBy("total_time_s", "engine", "mpi_ranks", "omp_threads")))
