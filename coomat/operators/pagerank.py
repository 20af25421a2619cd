"""PageRank by the power method, with dangling nodes, on DataFrames.

One step is a product of the transition cells with the ranks.  The engines differ in their plans:

* ``packed``: cells lie in the executors as arrays by pieces of sources, ranks as arrays by pieces of nodes, a step moves those;
* ``hybrid``: cells of sources with many of them meet their ranks in a broadcast join, the rest in a sort-merge join;
* ``broadcast``: ranks (counted under BROADCAST_ROWS) go to all tasks, cells are cached by destination, a step moves ranks;
* ``shuffle``: cells are cached by source and meet the ranks in a sort-merge join, whatever their number;
* ``serial``: the cells (counted, at most LOCAL_CELLS) go to one task that does all steps on arrays; only if asked for,
  and beyond that number the steps are those of ``auto``;
* ``dense``: like broadcast, over all N * N cells, up to DENSE_ROWS nodes;
* ``auto``: packed up to BROADCAST_ROWS nodes, hybrid beyond.

Nodes with more than HOT cells are salted: their cells lie in several partitions, and partial sums (or copies of the
rank) meet them there.  Error and the mass of dangling nodes come out of one aggregate a step over the cached ranks;
every CHECKPOINT_EVERY steps the ranks go to the shared checkpoint folder, so lineage stays short.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coomat.functions.scalars import percent_of
from coomat.operators.matrix import Matrix, span
from coomat.operators.multiply import BROADCAST_ROWS, DENSE_ROWS
from coomat.operators.packed import SIDE, added_to, piece_of, tile_sums, tiles
from coomat.operators.partition import scattered
from coomat.operators.spent import Spent, measured
from coomat.session import settled
from coomat.sources.graph import Graph

STRATEGIES = ("auto", "packed", "hybrid", "broadcast", "shuffle", "serial", "dense")
#: Cells that one task may hold: 24 bytes each, some 0.2 GB.
LOCAL_CELLS = 8_000_000
HOT = 1_000_000
#: Sources with more cells than this are heavy; with over HEAVY * MOST_HEAVY cells in all, those with the larger share of
#: cells, so that there are never more than MOST_HEAVY of them, whatever the graph.
HEAVY = 1000
MOST_HEAVY = 1_000_000
#: A step uses the ranks twice, so plans double with each step that is only cached.
CHECKPOINT_EVERY = 3


def _status(field_name: str) -> int:
    with open("/proc/self/status") as f:
        return next((int(x.split()[1]) for x in f if x.startswith(field_name + ":")), 0)


def rss_kb() -> int:
    """Resident memory of the driver process."""
    return _status("VmRSS")


def vm_kb() -> int:
    """Virtual memory of the driver process."""
    return _status("VmSize")


@dataclass
class Timer:
    """Named spans of wall clock; an unknown name has 0.0."""

    spans: dict[str, float] = field(default_factory=dict)
    begun: dict[str, float] = field(default_factory=dict)

    def start(self, name: str) -> None:
        self.begun[name] = time.perf_counter()

    def stop(self, name: str) -> float:
        took = time.perf_counter() - self.begun.pop(name, time.perf_counter())
        self.spans[name] = self.spans.get(name, 0.0) + took
        return took

    def get(self, name: str) -> float:
        return self.spans.get(name, 0.0)

    def lines(self) -> str:
        """All spans as text, in order of their names."""
        return "\n".join(f"{name}: {took:.6f} s" for name, took in sorted(self.spans.items()))

    def reset(self) -> None:
        self.spans.clear()
        self.begun.clear()


@dataclass
class Stats:
    """What a run did; ``row`` gives the 28 columns of the metrics files."""

    engine: str
    num_nodes: int
    num_edges: int
    csr_nnz: int
    damping: float
    tol: float
    mpi_ranks: int = 1
    omp_threads: int = 1
    iterations: int = 0
    converged: bool = False
    final_error: float = 0.0
    load_time_s: float = 0.0
    total_time_s: float = 0.0
    spmv_time_s: float = 0.0
    comm_time_s: float | None = None
    comp_time_s: float | None = None
    damp_time_s: float | None = None
    mem_before_kb: int = 0
    mem_after_kb: int = 0

    def row(self, dataset: str, l1_vs_ref: float = -1.0, top10_match: int = 0) -> dict:
        each = lambda x: x if x is None else 1000 * x / self.iterations if self.iterations else 0.0
        share = lambda x: x if x is None else percent_of(x, self.spmv_time_s)
        return {
            "engine": self.engine, "dataset": dataset, "num_nodes": self.num_nodes, "num_edges": self.num_edges, "csr_nnz": self.csr_nnz,
            "mpi_ranks": self.mpi_ranks, "omp_threads": self.omp_threads, "damping": self.damping, "tol": self.tol, "iterations": self.iterations,
            "converged": "yes" if self.converged else "no", "final_error": self.final_error, "load_time_s": self.load_time_s, "total_time_s": self.total_time_s,
            "spmv_time_s": self.spmv_time_s, "comm_time_s": self.comm_time_s, "comp_time_s": self.comp_time_s, "damp_time_s": self.damp_time_s,
            "comm_pct": share(self.comm_time_s), "comp_pct": share(self.comp_time_s),
            "avg_spmv_ms": each(self.spmv_time_s), "avg_comm_ms": each(self.comm_time_s), "avg_comp_ms": each(self.comp_time_s),
            "mem_before_kb": self.mem_before_kb, "mem_after_kb": self.mem_after_kb, "mem_peak_rss_kb": max(self.mem_before_kb, self.mem_after_kb),
            "l1_vs_ref": l1_vs_ref, "top10_match": top10_match,
        }


@dataclass(frozen=True)
class Result:
    ranks: DataFrame
    stats: Stats


def salted(cells: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """cells + salt, and (by, parts) of the hot nodes, which are at most cells / HOT rows."""
    hot = cells.groupBy(by).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select(by, F.ceil(F.col("c") / HOT).cast("int").alias("parts"))
    hot = settled(hot)
    other = "src" if by == "dst" else "dst"
    salt = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
    return cells.join(F.broadcast(hot), by, "left").select("src", "dst", "v", salt.alias("salt")), hot


def local_steps(cells: DataFrame, n: int, damping: float, max_iter: int, tol: float) -> DataFrame:
    """(src, dst, v) in one task -> node, rank, and in every row steps, error, and seconds of products and of damping."""

    def run(batches):
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        src, dst, v = (table.column(c).to_numpy() for c in ("src", "dst", "v")) if table else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ends = np.ones(n, bool)
        ends[src] = False
        rank, error, k, spmv, damp = np.full(n, 1.0 / n), 0.0, 0, 0.0, 0.0
        for k in range(1, max_iter + 1):
            began = time.perf_counter()
            flow = np.bincount(dst, weights=v * rank[src], minlength=n)
            between = time.perf_counter()
            new = damping * flow + (damping * rank[ends].sum() + (1 - damping)) / n
            error, rank = float(np.abs(new - rank).sum()), new
            spmv, damp = spmv + between - began, damp + time.perf_counter() - between
            if error < tol:
                break
        for lo in range(0, n, 1 << 16):
            some = rank[lo : lo + (1 << 16)]
            size = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + size)), pa.array(some), *(pa.array(np.full(size, x)) for x in (k, error, spmv, damp))], ["node", "rank", "steps", "error", "spmv", "damp"])

    return cells.select("src", "dst", "v").coalesce(1).mapInArrow(run, "node bigint, rank double, steps bigint, error double, spmv double, damp double")


def pagerank(graph: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, strategy: str = "auto", load_time_s: float = 0.0, counted: DataFrame | None = None) -> Result:
    """Ranks (node, rank) of all nodes.

    Starts at 1 / N; each step gives a node d * (what flows in) + (d * (old mass of dangling nodes) + 1 - d) / N.  Stops
    when the sum of absolute changes is under tol; the step that gets there counts.

    Communication is the share of task time that went into shuffles, and the damping is part of the product.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "dense" and graph.n > DENSE_ROWS:
        raise ValueError(f"more than {DENSE_ROWS} nodes for the dense strategy")
    spark, n, timer = graph.edges.sparkSession, graph.n, Timer()
    before = rss_kb()
    own = counted is None
    if own:
        counted = counted_cells(graph)
    nnz, edges = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    fits = nnz <= LOCAL_CELLS and n <= BROADCAST_ROWS
    way = "packed" if n <= BROADCAST_ROWS else "hybrid"
    if strategy == "broadcast" and n > BROADCAST_ROWS:
        way = "shuffle"
    elif strategy in ("hybrid", "broadcast", "shuffle", "dense") or strategy == "serial" and fits:
        way = strategy
    if way == "serial" and not nnz:
        way = "packed"
    stats = Stats(strategy, n, edges, nnz, damping, tol, load_time_s=load_time_s, mem_before_kb=before)
    stats.omp_threads, stats.mpi_ranks = 1, 1 if way == "serial" else spark.sparkContext.defaultParallelism
    timer.start("total")
    ranks = {"packed": _packed, "serial": _local}.get(way, _distributed)(graph, counted, way, damping, max_iter, tol, stats)
    stats.total_time_s, stats.mem_after_kb = timer.stop("total"), rss_kb()
    if own:
        counted.unpersist()
    return Result(ranks, stats)


def counted_cells(graph: Graph) -> DataFrame:
    """(dst, src, c) in the executors: one pass over the edges; degrees, dangling nodes and counts come from these."""
    return graph.edges.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)


def degrees(counted: DataFrame) -> DataFrame:
    """(src, deg) of counted cells."""
    return counted.groupBy("src").agg(F.sum("c").alias("deg"))


def shares(counted: DataFrame) -> DataFrame:
    """Counted cells -> src, dst, v: the share of the source's edges."""
    return counted.join(degrees(counted), "src").select("src", "dst", (F.col("c") / F.col("deg")).alias("v"))


_STATE = "r bigint, rank binary, degree binary, change double, lost double"


def _packed(graph: Graph, counted: DataFrame, way: str, damping: float, max_iter: int, tol: float, stats: Stats) -> DataFrame:
    """Ranks and degrees are pieces of SIDE nodes, as arrays; only the change and the lost mass come to the driver."""
    n, spark = graph.n, graph.edges.sparkSession
    size = lambda r: min(SIDE, n - r * SIDE)
    batch = lambda r, rank, degree, change: pa.RecordBatch.from_arrays([pa.array([r]), pa.array([rank.tobytes()], pa.binary()), pa.array([degree.tobytes()], pa.binary()), pa.array([change]), pa.array([float(rank[degree == 0].sum())])], ["r", "rank", "degree", "change", "lost"])

    def first(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = key[0].as_py()
        degree = np.zeros(size(r))
        for x in batches:
            known = x.filter(pa.compute.is_valid(x.column("src")))
            degree[known.column("src").to_numpy() - r * SIDE] = known.column("deg").to_numpy()
        yield batch(r, np.full(size(r), 1.0 / n), degree, 0.0)

    none = F.lit(None).cast("bigint")
    every = span(spark, -(-n // SIDE), "r").select("r", none.alias("src"), none.alias("deg"))
    state = settled(degrees(counted).select(piece_of("src").alias("r"), "src", F.col("deg").cast("bigint").alias("deg")).unionAll(every).groupBy("r").applyInArrow(first, _STATE))
    lost = state.agg(F.sum("lost")).first()[0]
    held, subs = tiles(counted.select(F.col("dst").alias("i"), F.col("src").alias("j"), F.col("c").cast("double").alias("v")), stats.csr_nnz)
    held = scattered(held, "c", "sub")

    def shares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each node sends along an edge."""
        for x in batches:
            for k in range(x.num_rows):
                rank, degree = (np.frombuffer(x.column(c)[k].as_buffer()) for c in ("rank", "degree"))
                yield pa.RecordBatch.from_arrays([x.column("r").slice(k, 1), pa.array([(rank / np.where(degree == 0, 1.0, degree)).tobytes()], pa.binary())], ["c", "x"])

    def step(lost: float):
        def stepped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = key[0].as_py()
            flow, rank, degree = np.zeros(size(r)), None, None
            for x in batches:
                for k in range(x.num_rows):
                    if x.column("rank")[k].is_valid:
                        rank, degree = (np.frombuffer(x.column(c)[k].as_buffer()) for c in ("rank", "degree"))
                    else:
                        added_to(flow, x.column("rows")[k], x.column("sums")[k])
            new = damping * flow + (damping * lost + (1 - damping)) / n
            yield batch(r, new, degree, float(np.abs(new - rank).sum()))

        return stepped

    spent, began, nothing = Spent(), time.perf_counter(), F.lit(None).cast("binary")
    with measured(spark, spent):
        for k in range(1, max_iter + 1):
            sums = tile_sums(held, subs, state.select("r", "rank", "degree").mapInArrow(shares_of, "c bigint, x binary"))
            both = sums.select("r", "rows", "sums", nothing.alias("rank"), nothing.alias("degree")).unionAll(state.select("r", nothing.alias("rows"), nothing.alias("sums"), "rank", "degree"))
            state = settled(both.groupBy("r").applyInArrow(step(lost), _STATE))
            error, lost = state.agg(F.sum("change"), F.sum("lost")).first()
            stats.iterations, stats.final_error, stats.converged = k, error, error < tol
            if stats.converged:
                break
    stats.spmv_time_s = time.perf_counter() - began
    stats.comm_time_s = stats.spmv_time_s * spent.share_moving
    stats.comp_time_s = stats.spmv_time_s - stats.comm_time_s
    held.unpersist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                rank = np.frombuffer(x.column("rank")[k].as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rank)) + x.column("r")[k].as_py() * SIDE), pa.array(rank)], ["node", "rank"])

    return settled(state.select("r", "rank").mapInArrow(rows, "node bigint, rank double"))


def _local(graph: Graph, counted: DataFrame, way: str, damping: float, max_iter: int, tol: float, stats: Stats) -> DataFrame:
    done = settled(local_steps(shares(counted), graph.n, damping, max_iter, tol))
    first = done.first()
    stats.iterations, stats.final_error, stats.converged = first.steps, first.error, first.error < tol and first.steps > 0
    stats.comm_time_s, stats.comp_time_s, stats.spmv_time_s, stats.damp_time_s = 0.0, first.spmv, first.spmv, first.damp
    return done.select("node", "rank")


def flows(kept: list[DataFrame], ranks: DataFrame, hot: DataFrame, way: str) -> DataFrame:
    """(node, y): what the ranks (src, rank) send to each destination.  kept: the cells; for hybrid those of light and of heavy sources."""
    cells = kept[0]
    if way == "hybrid":  # ``hot`` has the heavy sources, at most MOST_HEAVY
        few = ranks.join(F.broadcast(hot), "src", "left_semi")
        met = kept[1].join(F.broadcast(few), "src").select("dst", "v", "rank").unionAll(cells.join(ranks.hint("merge"), "src").select("dst", "v", "rank"))
    elif way == "shuffle":  # each part of a hot source has a copy of its rank
        copies = ranks.join(F.broadcast(hot), "src", "left").select("src", "rank", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        met = cells.join(copies.hint("merge"), ["src", "salt"])
    else:
        met = cells.join(F.broadcast(ranks), "src")
    return met.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("v") * F.col("rank")).alias("y"))


def heavy_apart(cells: DataFrame, nnz: int) -> tuple[DataFrame, DataFrame]:
    """cells + salt (0 for light sources, else the part of a heavy one), and the heavy sources, at most MOST_HEAVY."""
    least = max(HEAVY, -(-nnz // MOST_HEAVY))
    heavy = settled(cells.groupBy("src").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > least).select("src"))
    return cells.join(F.broadcast(heavy.withColumn("h", F.lit(1))), "src", "left").select("src", "dst", "v", F.when(F.col("h").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("dst"), F.lit(64))).cast("int").alias("salt")), heavy


def _distributed(graph: Graph, counted: DataFrame, way: str, damping: float, max_iter: int, tol: float, stats: Stats) -> DataFrame:
    n, by = graph.n, "dst" if way in ("broadcast", "dense") else "src"
    cells = shares(counted)
    if way == "dense":
        cells = Matrix(cells.select(F.col("dst").alias("i"), F.col("src").alias("j"), "v"), n, n).to_dense().df.select(F.col("j").alias("src"), F.col("i").alias("dst"), "v")
    dealt, hot = heavy_apart(cells, stats.csr_nnz) if way == "hybrid" else salted(cells, by)
    if way == "hybrid":  # the light ones by source alone, so a step moves ranks to them and no cells
        kept = [scattered(dealt.filter("salt = 0").drop("salt"), "src"), scattered(dealt.filter("salt > 0"), "src", "salt")]
    else:
        kept = [scattered(dealt, by, "salt")]
    inner = degrees(counted).select(F.col("src").alias("node"), F.lit(False).alias("end"))
    state = settled(graph.nodes().join(inner, "node", "left").select("node", F.coalesce("end", F.lit(True)).alias("end"), F.lit(1.0 / n).alias("rank")).repartition("node"))
    loss = state.agg(F.coalesce(F.sum(F.when(F.col("end"), F.col("rank"))), F.lit(0.0))).first()[0]
    held: list[DataFrame] = []
    spent, began = Spent(), time.perf_counter()
    with measured(graph.edges.sparkSession, spent):
        for k in range(1, max_iter + 1):
            flow = flows(kept, state.select(F.col("node").alias("src"), "rank"), hot, way)
            new = damping * F.coalesce(F.col("y"), F.lit(0.0)) + (damping * loss + (1 - damping)) / n
            state = state.join(flow, "node", "left").select("node", "end", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
            if k % CHECKPOINT_EVERY:
                state = state.persist(StorageLevel.MEMORY_AND_DISK)
                held.append(state)
            else:
                state = settled(state)
            error, loss = state.agg(F.sum("change"), F.coalesce(F.sum(F.when(F.col("end"), F.col("rank"))), F.lit(0.0))).first()
            stats.iterations, stats.final_error, stats.converged = k, error, error < tol
            if not k % CHECKPOINT_EVERY:
                while held:
                    held.pop().unpersist()
            if stats.converged:
                break
    stats.spmv_time_s = time.perf_counter() - began
    stats.comm_time_s = stats.spmv_time_s * spent.share_moving
    stats.comp_time_s = stats.spmv_time_s - stats.comm_time_s
    state = settled(state.select("node", "rank"))
    for x in (*held, *kept):
        x.unpersist()
    return state


def top_k(ranks: DataFrame, k: int = 10) -> DataFrame:
    """The k highest ranks; equal ranks by node."""
    return ranks.orderBy(F.desc("rank"), "node").limit(k)


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (l1).  Both sides must have the same nodes; a node that one lacks counts with its whole rank."""
    x, y = a.select("node", F.col("rank").alias("x")), b.select("node", F.col("rank").alias("y"))
    return x.join(y, "node", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("l1"))


def top_match(a: DataFrame, b: DataFrame, k: int = 10) -> int:
    """At how many of the first min(k, N) places both have the same node."""
    at = Window.orderBy(F.desc("rank"), "node")
    placed = lambda r: top_k(r, k).withColumn("p", F.row_number().over(at)).select("p", "node")
    return placed(a).join(placed(b), ["p", "node"]).count()


def skips(graph: Graph, strategy: str) -> str | None:
    """Why an engine can't take a graph, or None."""
    if strategy == "dense" and graph.n > DENSE_ROWS:
        return f"more than {DENSE_ROWS} nodes"
    if strategy in ("broadcast", "packed") and graph.n > BROADCAST_ROWS:
        return f"more than {BROADCAST_ROWS} nodes"
    if strategy == "serial" and (graph.n > BROADCAST_ROWS or graph.edges.limit(LOCAL_CELLS + 1).count() > LOCAL_CELLS):
        return f"more than {LOCAL_CELLS} edges or {BROADCAST_ROWS} nodes"
    return None


def compare(graph: Graph, dataset: str, strategies: tuple[str, ...] = ("auto", "broadcast", "shuffle"), reference: DataFrame | None = None, skipped: dict[str, str] | None = None, **how) -> list[dict]:
    """A metrics row for each strategy; those that can't take the graph go to ``skipped``, if given, with the reason, and
    else do it by the way that takes any size.  All share the counted cells, so the edges are read once."""
    rows, counted = [], counted_cells(graph)
    for s in strategies:
        if skipped is not None and (why := skips(graph, s)) is not None:
            skipped[s] = why
            continue
        done = pagerank(graph, strategy=s, counted=counted, **how)
        l1 = l1_distance(done.ranks, reference).first().l1 if reference is not None else -1.0
        rows.append(done.stats.row(dataset, l1, top_match(done.ranks, reference) if reference is not None else 0))
    counted.unpersist()
    return rows


def summary(rows: list[dict], skipped: dict[str, str] | None = None) -> str:
    """A line for each engine: steps, error, times and agreement with the reference; SKIP and the reason for the others."""
    lines = [f"{'engine':<12}{'steps':>6}{'error':>12}{'total s':>10}{'step ms':>10}{'l1':>12}{'top 10':>8}"]
    lines += [f"{r['engine']:<12}{r['iterations']:>6}{r['final_error']:>12.3e}{r['total_time_s']:>10.3f}{r['avg_spmv_ms']:>10.3f}{r['l1_vs_ref']:>12.3e}{r['top10_match']:>8}" for r in rows]
    return "\n".join([*lines, *(f"{name:<12}  SKIP  {why}" for name, why in (skipped or {}).items())])


def version(spark: SparkSession) -> str:
    return f"Spark {spark.version}, {os.cpu_count()} cores"
