"""Registered queries over the star-schema tables, and the same in DuckDB SQL.

Sources: A(supplier, part) sums quantities, which are whole numbers; x(part) is the part's size; B(part, month) counts
lines; E holds the embeddings; G has an edge from an order's customer to each line's supplier, parallel edges kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coomat.functions import scalars
from coomat.operators import multiply as mul
from coomat.operators import pagerank as pr
from coomat.operators.matrix import Matrix, Vector, span
from coomat.operators.partition import part_table, with_part
from coomat.plans import results
from coomat.session import ensure_checkpoints
from coomat.sources.graph import Graph, parse_edges, read_snap
from coomat.sources.metrics import COLUMNS, metrics_frame, read_tagged, write_metrics
from coomat.sources.vectors import read_meta, read_rank_vector, write_meta, write_rank_vector


class Tables:
    """The sources of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        self.__dict__[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")  # the schema is read once
        return self.__dict__[name]

    def counts_of(self, *keys: tuple[str, str]) -> list[int]:
        """The largest key of each table plus one, in one job."""
        found = [getattr(self, table).agg(F.lit(k).alias("k"), F.max(key).cast("bigint").alias("most")) for k, (table, key) in enumerate(keys)]
        most = {r.k: r.most for r in reduce(DataFrame.unionAll, found).collect()}
        return [0 if most[k] is None else most[k] + 1 for k in range(len(keys))]

    def count_of(self, table: str, key: str) -> int:
        return self.counts_of((table, key))[0]

    def n_supp(self) -> int:
        return self.count_of("supplier", "s_suppkey")

    def n_part(self) -> int:
        return self.count_of("part", "p_partkey")

    def a(self) -> Matrix:
        return Matrix.sparse(self.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")), self.n_supp(), self.n_part())

    def b(self) -> Matrix:
        return Matrix.sparse(self.lineitem.select(F.col("l_partkey").alias("i"), (F.month("l_shipdate") - 1).alias("j"), F.lit(1.0).alias("v")), self.n_part(), 12)

    def x(self) -> Vector:
        return Vector.dense(self.part.select(F.col("p_partkey").alias("i"), F.col("p_size").alias("v")), self.n_part())

    def e(self) -> Matrix:
        cells = self.embeddings.select(F.col("vec_id").cast("bigint").alias("i"), F.posexplode("embedding").alias("j", "v"))
        return Matrix(cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")), self.count_of("embeddings", "vec_id"), 64, False)

    def w(self) -> Matrix:
        grid = Matrix.filled(self.spark, 64, 4).df
        return Matrix(grid.withColumn("v", ((F.col("i") + 2 * F.col("j")) % 5 - 2).cast("double")), 64, 4, False)

    def g(self) -> Graph:
        n, m = self.counts_of(("customer", "c_custkey"), ("supplier", "s_suppkey"))
        edges = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + n).alias("dst"))
        return Graph(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")), n + m)


_A = "A AS (SELECT l_suppkey::bigint AS i, l_partkey::bigint AS j, sum(l_quantity)::double AS v FROM lineitem GROUP BY 1, 2)"
_B = "B AS (SELECT l_partkey::bigint AS i, (month(l_shipdate) - 1)::bigint AS j, count(*)::double AS v FROM lineitem GROUP BY 1, 2)"
_X = "x AS (SELECT p_partkey::bigint AS i, p_size::double AS v FROM part)"
_NS = "(SELECT max(s_suppkey) + 1 FROM supplier)"
_NP = "(SELECT max(p_partkey) + 1 FROM part)"
_S = f"S AS (SELECT range::bigint AS i FROM range({_NS}))"
_NC = "(SELECT max(c_custkey) + 1 FROM customer)"
_E = "E AS (SELECT vec_id::bigint AS i, (unnest(range(1, 65)) - 1)::bigint AS j, unnest(embedding)::double AS v FROM embeddings)"
_W = "W AS (SELECT a.range::bigint AS i, b.range::bigint AS j, ((a.range + 2 * b.range) % 5 - 2)::double AS v FROM range(64) a, range(4) b)"
_G = f"G AS (SELECT o_custkey::bigint AS src, (l_suppkey + {_NC})::bigint AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), N AS (SELECT range::bigint AS node FROM range({_NC} + {_NS}))"
_SPMV = f"WITH {_A}, {_X}, {_S}, P AS (SELECT A.i, sum(A.v * x.v) AS v FROM A JOIN x ON A.j = x.i GROUP BY A.i) SELECT S.i, coalesce(P.v, 0.0::double) AS v FROM S LEFT JOIN P ON S.i = P.i"
_AB = "SELECT A.i, B.j, sum(A.v * B.v) AS v FROM A JOIN B ON A.j = B.i GROUP BY 1, 2"


def _ranks_sql(steps: int) -> str:
    """CTEs R0 to R<steps>, each (node, r)."""
    out = f"""{_G}, D AS (SELECT src, count(*)::double AS deg FROM G GROUP BY 1), C AS (SELECT dst, G.src, count(*)::double AS c FROM G GROUP BY 1, 2),
M AS MATERIALIZED (SELECT C.dst, C.src, C.c / D.deg AS v FROM C JOIN D ON C.src = D.src), T AS MATERIALIZED (SELECT node FROM N WHERE node NOT IN (SELECT src FROM D)),
R0 AS MATERIALIZED (SELECT node, 1.0::double / (SELECT count(*) FROM N) AS r FROM N)"""
    for k in range(steps):
        out += f""",
R{k + 1} AS MATERIALIZED (SELECT N.node, 0.85::double * coalesce(Y.y, 0.0::double) + (0.85::double * (SELECT coalesce(sum(r), 0.0::double) FROM R{k} WHERE node IN (SELECT node FROM T)) + 0.15::double) / (SELECT count(*) FROM N) AS r
FROM N LEFT JOIN (SELECT M.dst, sum(M.v * R{k}.r) AS y FROM M JOIN R{k} ON M.src = R{k}.node GROUP BY 1) Y ON N.node = Y.dst)"""
    return out


def _metrics(t: Tables) -> DataFrame:
    """Runs as lines of orders tell them: a dataset for each return flag, an engine by supplier, ranks by line, threads by part.

    Lines count as edges, suppliers as nodes, quantities as work that ranks and threads share, line numbers as computation.
    """
    e, p, threads = F.col("l_suppkey") % 3, F.pow(F.lit(2), F.col("l_linenumber") % 4).cast("int"), F.pow(F.lit(2), F.col("l_partkey") % 3).cast("int")
    runs = t.lineitem.groupBy(F.col("l_returnflag").alias("_ds"), e.alias("e"), p.alias("p"), threads.alias("t")).agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").cast("double").alias("n"), F.countDistinct("l_suppkey").alias("s"), F.count(F.lit(1)).alias("c"), F.max("l_partkey").alias("m"))
    name = F.when(F.col("e") == 0, "CSR_Serial").when(F.col("e") == 1, "MPI_CSR").otherwise("Hybrid")
    return runs.select(
        F.concat(name, F.lit("_p"), F.col("p"), F.lit("_t"), F.col("t")).alias("engine"), F.col("p").alias("mpi_ranks"), F.col("t").alias("omp_threads"), (F.col("q") / (F.col("p") * F.col("t"))).alias("total_time_s"),
        (F.col("p") - 1).cast("double").alias("comm_time_s"), F.col("n").alias("comp_time_s"), F.col("s").alias("num_nodes"), F.col("c").alias("num_edges"), F.col("m").alias("mem_peak_rss_kb"), "_ds",
    )


_MET = """met AS (SELECT name || '_p' || p || '_t' || t AS engine, p AS mpi_ranks, t AS omp_threads, q / (p * t) AS total_time_s, (p - 1)::double AS comm_time_s, n AS comp_time_s, s AS num_nodes, c AS num_edges, m AS mem_peak_rss_kb, _ds
 FROM (SELECT l_returnflag AS _ds, CASE l_suppkey % 3 WHEN 0 THEN 'CSR_Serial' WHEN 1 THEN 'MPI_CSR' ELSE 'Hybrid' END AS name, (2 ** (l_linenumber % 4))::integer AS p, (2 ** (l_partkey % 3))::integer AS t,
  sum(l_quantity)::double AS q, sum(l_linenumber)::double AS n, count(DISTINCT l_suppkey)::bigint AS s, count(*)::bigint AS c, max(l_partkey)::bigint AS m FROM lineitem GROUP BY 1, 2, 3, 4))"""


def _cells(m: Matrix) -> DataFrame:
    return m.df.select("i", "j", "v")


def _ones(t: Tables, n: int) -> Vector:
    return Vector(span(t.spark, n).withColumn("v", F.lit(1.0)), n)


def _row_ptr(t: Tables) -> DataFrame:
    return t.a().row_ptr()


def _ranks(t: Tables, steps: int = 10) -> DataFrame:
    return pr.pagerank(t.g(), max_iter=steps, tol=0.0).ranks


def _rounded(ranks: DataFrame, digits: int = 10) -> DataFrame:
    return ranks.select("node", F.round("rank", digits).alias("rank"))


def _converged_sql(most: int, tol: float) -> str:
    """The ranks of the first step whose change is under tol; ``most`` steps must get there."""
    changes = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(x.r - y.r)) AS e FROM R{k} x JOIN R{k - 1} y ON x.node = y.node" for k in range(1, most + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, node, r FROM R{k}" for k in range(1, most + 1))
    return f"WITH {_ranks_sql(most)}, E AS ({changes}), F AS (SELECT min(k) AS k FROM E WHERE e < {tol}::double), Q AS ({ranks}) SELECT node, round(r, 8) AS rank FROM Q JOIN F ON Q.k = F.k"


def _halves(t: Tables) -> Matrix:
    """A again, each line as two entries of half the quantity."""
    half = t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), (F.col("l_quantity") / 2).alias("v"))
    return Matrix.sparse(half.unionAll(half), t.n_supp(), t.n_part())


def _shape(t: Tables) -> DataFrame:
    a = t.a()
    return a.nnz().select(F.lit(a.n_rows).cast("bigint").alias("n_rows"), F.lit(a.n_cols).cast("bigint").alias("n_cols"), F.lit(a.size).cast("bigint").alias("size"), F.lit(a.is_square).alias("is_square"), F.col("nnz").alias("stored"))


def _compressed(t: Tables, by_row: bool) -> Matrix:
    """B from the tables of its three arrays."""
    b = t.b()
    return Matrix.from_csr_tables(*b.csr_tables(), b.n_cols) if by_row else Matrix.from_csc_tables(*b.csc_tables(), b.n_rows)


def _dense_values(t: Tables) -> Matrix:
    b = t.b()
    return Matrix.from_values(b.to_dense().df.select((F.col("i") * b.n_cols + F.col("j")).alias("pos"), F.col("v").alias("value")), b.n_rows, b.n_cols)


def _shared(t: Tables, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoints(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _snap_file(t: Tables) -> str:
    """The graph as edge-list text with ids from 1, comments and blank lines."""
    path, edges = _shared(t, "edges"), t.g().edges
    lines = edges.select(F.concat(F.lit(" "), F.col("src") + 1, F.lit("\t "), F.col("dst") + 1, F.lit(" x")).alias("value"))
    noise = t.spark.createDataFrame([("# 0 0",), ("",), ("no edge",), ("7",)], "value string")
    lines.union(noise).write.text(path)
    return path


def _snap_text(t: Tables) -> Graph:
    return read_snap(t.spark, _snap_file(t))


def _snap_ids(t: Tables) -> DataFrame:
    """Base, smallest and largest raw id, and the nodes of the graph that is read."""
    path = _snap_file(t)
    graph = read_snap(t.spark, path)
    ids = parse_edges(t.spark.read.text(path)).agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high"))
    base = graph.edges.agg(F.min(F.least("src", "dst")).alias("shifted"))
    return ids.crossJoin(base).select((F.col("low") - F.col("shifted")).alias("base"), "low", "high", F.lit(graph.n).cast("bigint").alias("nodes"))


def _rank_files(t: Tables) -> DataFrame:
    """Ranks written as a vector in files and read again."""
    path = _shared(t, "ranks")
    write_rank_vector(_ranks(t, 4), path, 1000)
    return _rounded(read_rank_vector(t.spark, path))


def _meta_file(t: Tables) -> DataFrame:
    """What is known of the graph, written as key=value lines and read again."""
    path, g = _shared(t, "meta"), t.g()
    known = g.edges.agg(F.count(F.lit(1)).cast("string").alias("E"), F.lit(str(g.n)).alias("N"), F.concat_ws(",", F.min("dst"), F.max("dst")).alias("targets"))
    write_meta(known.select(F.explode(F.create_map(*(x for c in known.columns for x in (F.lit(c), F.col(c)))))), path)
    return read_meta(t.spark, path)


def _metrics_csv(t: Tables) -> DataFrame:
    """Metrics of one dataset, written as CSV and read again with their tag."""
    path, known = _shared(t, "metrics"), _metrics(t)
    rows = known.filter("_ds = 'A'").select(*(F.col(n).cast(kind).alias(n) if n in known.columns else F.lit(None).cast(kind).alias(n) for n, kind in COLUMNS))
    write_metrics(rows, path)
    return read_tagged(t.spark, {"A": path})


def _top10(t: Tables) -> DataFrame:
    return _rounded(pr.top_k(_ranks(t).select("node", F.round("rank", 10).alias("rank"))))


def _with_transpose(a: Matrix) -> Matrix:
    return mul.matmul(a, a.transpose(), "gustavson")


def _scattered_products(t: Tables) -> DataFrame:
    """A x and A 1 over one scattered A."""
    a = t.a().scatter("j")
    first, second = (mul.spmv(a, x, "shuffle").df for x in (t.x(), _ones(t, t.n_part())))
    return first.join(second.select("i", F.col("v").alias("w")), "i")


def _snap_roundtrip(t: Tables) -> DataFrame:
    edges = t.g().edges
    lines = edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
    return parse_edges(lines).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


#: name -> (Spark query over Tables, DuckDB SQL or None)
CATALOGUE: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {
    "nnz": (lambda t: t.a().nnz(), f"WITH {_A} SELECT count(*)::bigint AS nnz FROM A"),
    "row_nnz": (lambda t: t.a().row_nnz(), f"WITH {_A} SELECT i, count(*)::bigint AS n FROM A GROUP BY i"),
    "col_nnz": (lambda t: t.a().col_nnz(), f"WITH {_A} SELECT j, count(*)::bigint AS n FROM A GROUP BY j"),
    "density": (lambda t: t.a().density().select(F.round("density", 8).alias("density")), f"WITH {_A} SELECT round(100.0::double * count(*) / ({_NS}::double * {_NP}::double), 8) AS density FROM A"),
    "row_ptr": (_row_ptr, f"WITH {_A}, L AS (SELECT range::bigint AS k FROM range({_NS} + 1)), C AS (SELECT L.k, count(A.i) AS c FROM L LEFT JOIN A ON A.i = L.k GROUP BY L.k) SELECT k, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS ptr FROM C"),
    "col_ptr": (lambda t: t.a().col_ptr(), f"WITH {_A}, L AS (SELECT range::bigint AS k FROM range({_NP} + 1)), C AS (SELECT L.k, count(A.j) AS c FROM L LEFT JOIN A ON A.j = L.k GROUP BY L.k) SELECT k, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS ptr FROM C"),
    "row_partition_p4": (lambda t: part_table(t.spark, t.n_supp(), 4), f"WITH {_S}, Q AS (SELECT i, (ntile(4) OVER (ORDER BY i) - 1)::integer AS part FROM S) SELECT part, min(i)::bigint AS start_row, (max(i) + 1)::bigint AS end_row FROM Q GROUP BY part"),
    "row_partition_p7": (lambda t: part_table(t.spark, t.n_supp(), 7), f"WITH {_S}, Q AS (SELECT i, (ntile(7) OVER (ORDER BY i) - 1)::integer AS part FROM S) SELECT part, min(i)::bigint AS start_row, (max(i) + 1)::bigint AS end_row FROM Q GROUP BY part"),
    "from_dense": (lambda t: _cells(t.b().to_dense().from_dense()), f"WITH {_B} SELECT i, j, v FROM B WHERE NOT isnan(v) AND abs(v) > 1e-15"),
    "to_dense": (lambda t: _cells(t.b().to_dense()), f"WITH {_B}, Z AS (SELECT a.range::bigint AS i, b.range::bigint AS j FROM range({_NP}) a, range(12) b) SELECT Z.i, Z.j, coalesce(B.v, 0.0::double) AS v FROM Z LEFT JOIN B ON Z.i = B.i AND Z.j = B.j"),
    "transpose": (lambda t: _cells(t.a().transpose()), f"WITH {_A} SELECT j AS i, i AS j, v FROM A"),
    "csr_csc_roundtrip": (lambda t: _cells(t.a().by_cols().by_rows()), f"WITH {_A} SELECT i, j, v FROM A"),
    "get_element": (lambda t: t.a().element(3, 5), f"WITH {_A} SELECT coalesce(sum(v), 0.0::double) AS v FROM A WHERE i = 3 AND j = 5"),
    "row_slice": (lambda t: _cells(t.a().row_slice(3, 9)), f"WITH {_A} SELECT i - 3 AS i, j, v FROM A WHERE i >= 3 AND i < 9"),
    "col_slice": (lambda t: _cells(t.a().col_slice(10, 40)), f"WITH {_A} SELECT i, j - 10 AS j, v FROM A WHERE j >= 10 AND j < 40"),
    "block": (lambda t: _cells(t.e().block(2, 8, 20, 16)), f"WITH {_E} SELECT i - 2 AS i, j - 8 AS j, v FROM E WHERE i >= 2 AND i < 22 AND j >= 8 AND j < 24"),
    "matrix_differs": (lambda t: t.a().mismatches(Matrix(t.a().df.filter("i % 2 = 0"), t.n_supp(), t.n_part())), f"WITH {_A} SELECT count(*)::bigint AS n FROM A WHERE i % 2 <> 0 AND v <> 0"),
    "norm_f": (lambda t: t.a().norm_f().select(F.round("norm_f", 6).alias("norm_f")), f"WITH {_A} SELECT round(sqrt(sum(v * v)), 6) AS norm_f FROM A"),
    "norm_max": (lambda t: t.a().norm_max(), f"WITH {_A} SELECT max(abs(v)) AS norm_max FROM A"),
    "dense_vector": (lambda t: mul.spmv(t.e(), Vector(span(t.spark, 64).withColumn("v", F.col("i").cast("double")), 64)).df.select("i", F.round("v", 6).alias("v")), f"WITH {_E} SELECT i, round(sum(v * j), 6) AS v FROM E GROUP BY i"),
    "spmv": (lambda t: mul.spmv(t.a(), t.x()).df, _SPMV),
    "spmv_broadcast": (lambda t: mul.spmv(t.a(), t.x(), "broadcast").df, _SPMV),
    "spmv_shuffle": (lambda t: mul.spmv(t.a(), t.x(), "shuffle").df, _SPMV),
    "scattered_products": (_scattered_products, f"WITH {_A}, {_X}, {_S}, P AS (SELECT A.i, sum(A.v * x.v) AS v, sum(A.v) AS w FROM A JOIN x ON A.j = x.i GROUP BY A.i) SELECT S.i, coalesce(P.v, 0.0::double) AS v, coalesce(P.w, 0.0::double) AS w FROM S LEFT JOIN P ON S.i = P.i"),
    "spmv_dense": (lambda t: mul.spmv(t.a(), t.x(), "dense").df, _SPMV),
    "spmv_into_slice": (lambda t: mul.multiply_into(t.a(), t.x(), _ones(t, t.n_supp() + 15), 7).df, f"WITH {_A}, {_X}, P AS (SELECT A.i + 7 AS i, sum(A.v * x.v) AS v FROM A JOIN x ON A.j = x.i GROUP BY A.i), Z AS (SELECT range::bigint AS i FROM range({_NS} + 15)) SELECT Z.i, CASE WHEN Z.i >= 7 AND Z.i < {_NS} + 7 THEN coalesce(P.v, 0.0::double) ELSE 1.0::double END AS v FROM Z LEFT JOIN P ON Z.i = P.i"),
    "csr_dense": (lambda t: _cells(mul.matmul(Matrix(t.e().df, t.e().n_rows, 64), t.w())).select("i", "j", F.round("v", 6).alias("v")), f"WITH {_E}, {_W} SELECT E.i, W.j, round(sum(E.v * W.v), 6) AS v FROM E JOIN W ON E.j = W.i GROUP BY 1, 2"),
    "dense_dense": (lambda t: _cells(mul.matmul(t.e(), t.w())).select("i", "j", F.round("v", 6).alias("v")), f"WITH {_E}, {_W} SELECT E.i, W.j, round(sum(E.v * W.v), 6) AS v FROM E JOIN W ON E.j = W.i GROUP BY 1, 2"),
    "dense_dense_blocked": (lambda t: _cells(mul.blocked_matmul(t.e(), t.w(), 32)).select("i", "j", F.round("v", 6).alias("v")), f"WITH {_E}, {_W} SELECT E.i, W.j, round(sum(E.v * W.v), 6) AS v FROM E JOIN W ON E.j = W.i GROUP BY 1, 2"),
    "csr_csr": (lambda t: _cells(mul.matmul(t.a(), t.b())), f"WITH {_A}, {_B}, P AS ({_AB}) SELECT i, j, v FROM P WHERE abs(v) > 1e-15"),
    "csr_csr_shuffle": (lambda t: _cells(mul.matmul(t.a(), t.b(), "shuffle")), f"WITH {_A}, {_B}, P AS ({_AB}) SELECT i, j, v FROM P WHERE abs(v) > 1e-15"),
    "csr_csc": (lambda t: _cells(_with_transpose(t.a().scatter("j"))), f"WITH {_A} SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM A x JOIN A y ON x.j = y.j GROUP BY 1, 2 HAVING abs(sum(x.v * y.v)) > 1e-15"),
    "product_bounds": (lambda t: mul.product_bounds(t.a(), t.b()), f"WITH {_A}, {_B}, K AS (SELECT i, count(*) AS c FROM B GROUP BY i) SELECT A.i, sum(K.c)::bigint AS bound FROM A JOIN K ON A.j = K.i GROUP BY A.i"),
    "csr_csr_blocks": (lambda t: _cells(mul.blocked_matmul(t.a(), t.b(), 64)), f"WITH {_A}, {_B}, P AS ({_AB}) SELECT i, j, v FROM P WHERE abs(v) > 1e-15"),
    "csr_csr_gustavson": (lambda t: _cells(mul.matmul(t.a(), t.b(), "gustavson")), f"WITH {_A}, {_B}, P AS ({_AB}) SELECT i, j, v FROM P WHERE abs(v) > 1e-15"),
    "symbolic_nnz": (lambda t: mul.symbolic_nnz(t.a(), t.b()), f"WITH {_A}, {_B}, {_S}, P AS (SELECT A.i, count(DISTINCT B.j) AS n FROM A JOIN B ON A.j = B.i GROUP BY A.i) SELECT S.i, coalesce(P.n, 0)::bigint AS n FROM S LEFT JOIN P ON S.i = P.i"),
    "matmul_add": (lambda t: _cells(mul.multiply_add(t.a(), t.b(), Matrix.filled(t.spark, t.n_supp() + 4, 12, 1.0), 3)), f"WITH {_A}, {_B}, P AS ({_AB}), Z AS (SELECT a.range::bigint AS i, b.range::bigint AS j FROM range({_NS} + 4) a, range(12) b) SELECT Z.i, Z.j, 1.0::double + coalesce(P.v, 0.0::double) AS v FROM Z LEFT JOIN P ON Z.i = P.i + 3 AND Z.j = P.j"),
    "out_degree": (lambda t: t.g().out_degree(), f"WITH {_G} SELECT src AS node, count(*)::bigint AS deg FROM G GROUP BY 1"),
    "in_degree": (lambda t: t.g().in_degree(), f"WITH {_G} SELECT dst AS node, count(*)::bigint AS deg FROM G GROUP BY 1"),
    "dangling": (lambda t: t.g().dangling(), f"WITH {_G} SELECT node FROM N WHERE node NOT IN (SELECT src FROM G)"),
    "transition": (lambda t: _cells(t.g().transition()).select("i", "j", F.round("v", 12).alias("v")), f"WITH {_G}, D AS (SELECT src, count(*)::double AS deg FROM G GROUP BY 1) SELECT G.dst AS i, G.src AS j, round(count(*)::double / any_value(D.deg), 12) AS v FROM G JOIN D ON G.src = D.src GROUP BY 1, 2"),
    "dangling_mass": (lambda t: _ranks(t, 3).join(t.g().dangling(), "node", "left_semi").agg(F.round(F.coalesce(F.sum("rank"), F.lit(0.0)), 10).alias("mass")), f"WITH {_ranks_sql(3)} SELECT round(coalesce(sum(r), 0.0::double), 10) AS mass FROM R3 WHERE node IN (SELECT node FROM T)"),
    "pagerank_10": (lambda t: _rounded(_ranks(t)), f"WITH {_ranks_sql(10)} SELECT node, round(r, 10) AS rank FROM R10"),
    "pagerank_top10": (_top10, f"WITH {_ranks_sql(10)} SELECT node, round(r, 10) AS rank FROM R10 ORDER BY round(r, 10) DESC, node LIMIT 10"),
    "pagerank_l1_step": (lambda t: pr.l1_distance(_ranks(t, 2), _ranks(t, 3)).select(F.round("l1", 8).alias("l1")), f"WITH {_ranks_sql(3)} SELECT round(sum(abs(R3.r - R2.r)), 8) AS l1 FROM R3 JOIN R2 ON R3.node = R2.node"),
    "snap_roundtrip": (_snap_roundtrip, f"WITH {_G} SELECT src, dst, count(*)::bigint AS n FROM G GROUP BY 1, 2"),
    "speedup": (lambda t: results.speedup(_metrics(t), "MPI_CSR").select("_ds", "mpi_ranks", F.round("speedup", 8).alias("speedup")), f"WITH {_MET}, o AS (SELECT _ds, mpi_ranks, total_time_s AS t FROM met WHERE starts_with(engine, 'MPI_CSR') AND omp_threads = 1) SELECT o._ds, o.mpi_ranks, round(b.t / o.t, 8) AS speedup FROM o JOIN o b ON o._ds = b._ds AND b.mpi_ranks = 1"),
    "grid": (lambda t: results.grid(_metrics(t), "Hybrid").select("_ds", "mpi_ranks", *(F.round(c, 8).alias(c) for c in ("t1", "t2", "t4"))), f"WITH {_MET} SELECT _ds, mpi_ranks, " + ", ".join(f"round(min(total_time_s) FILTER (omp_threads = {k}), 8) AS t{k}" for k in (1, 2, 4)) + " FROM met WHERE starts_with(engine, 'Hybrid') GROUP BY 1, 2"),
    "best_config": (lambda t: results.best_config(_metrics(t)).withColumn("total_time_s", F.round("total_time_s", 8)), f"WITH {_MET}, o AS (SELECT *, row_number() OVER (PARTITION BY _ds ORDER BY total_time_s, engine, mpi_ranks, omp_threads) AS k FROM met) SELECT _ds, engine, mpi_ranks, omp_threads, round(total_time_s, 8) AS total_time_s FROM o WHERE k = 1"),
    "comm_share": (lambda t: results.comm_share(_metrics(t)).withColumn("comm_share_pct", F.round("comm_share_pct", 8)), f"WITH {_MET} SELECT _ds, engine, mpi_ranks, omp_threads, round(100 * comm_time_s / (comm_time_s + comp_time_s), 8) AS comm_share_pct FROM met WHERE comm_time_s + comp_time_s > 0"),
    "setup_stats": (lambda t: results.setup(_metrics(t)).withColumn("density_pct", F.round("density_pct", 8)), f"WITH {_MET}, o AS (SELECT *, row_number() OVER (PARTITION BY _ds ORDER BY engine, mpi_ranks, omp_threads) AS k FROM met) SELECT _ds, num_nodes, num_edges, round(100.0::double * num_edges / (num_nodes::double * num_nodes::double), 8) AS density_pct FROM o WHERE k = 1"),
    "identity": (lambda t: _cells(Matrix.identity(t.spark, t.n_supp(), 12)), f"SELECT a.range::bigint AS i, b.range::bigint AS j, CASE WHEN a.range = b.range THEN 1.0::double ELSE 0.0::double END AS v FROM range({_NS}) a, range(12) b"),
    "fill": (lambda t: _cells(t.b().fill(2.5)), f"SELECT a.range::bigint AS i, b.range::bigint AS j, 2.5::double AS v FROM range({_NP}) a, range(12) b"),
    "set_zero": (lambda t: _cells(t.b().set_zero()), f"SELECT a.range::bigint AS i, b.range::bigint AS j, 0.0::double AS v FROM range({_NP}) a, range(12) b"),
    "matrix_equals": (lambda t: t.a().mismatches(_halves(t)), f"WITH {_A}, H AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity / 2 AS v FROM lineitem UNION ALL SELECT l_suppkey, l_partkey, l_quantity / 2 FROM lineitem), Q AS (SELECT i, j, sum(v) AS v FROM H GROUP BY 1, 2) SELECT count(*)::bigint AS n FROM A FULL JOIN Q ON A.i = Q.i AND A.j = Q.j WHERE coalesce(A.v, 0) <> coalesce(Q.v, 0)"),
    "shape": (_shape, f"WITH {_A} SELECT {_NS}::bigint AS n_rows, {_NP}::bigint AS n_cols, ({_NS} * {_NP})::bigint AS size, {_NS} = {_NP} AS is_square, count(*)::bigint AS stored FROM A"),
    "csr_from_arrays": (lambda t: _cells(_compressed(t, True)), f"WITH {_B} SELECT i, j, v FROM B"),
    "csc_from_arrays": (lambda t: _cells(_compressed(t, False)), f"WITH {_B} SELECT i, j, v FROM B"),
    "dense_from_values": (lambda t: _cells(_dense_values(t)), f"WITH {_B}, Z AS (SELECT a.range::bigint AS i, b.range::bigint AS j FROM range({_NP}) a, range(12) b) SELECT Z.i, Z.j, coalesce(B.v, 0.0::double) AS v FROM Z LEFT JOIN B ON Z.i = B.i AND Z.j = B.j"),
    "dense_at": (lambda t: t.e().element(3, 7), f"WITH {_E} SELECT coalesce(sum(v), 0.0::double) AS v FROM E WHERE i = 3 AND j = 7"),
    "dense_transpose": (lambda t: _cells(t.e().transpose()), f"WITH {_E} SELECT j AS i, i AS j, v FROM E"),
    "row_owner": (lambda t: with_part(span(t.spark, t.n_supp()), t.n_supp(), 7).select(F.col("i").cast("bigint").alias("i"), F.col("part").cast("int").alias("part")), f"WITH {_S} SELECT i, (ntile(7) OVER (ORDER BY i) - 1)::integer AS part FROM S"),
    "col_partition_p5": (lambda t: part_table(t.spark, t.n_part(), 5), f"WITH Q AS (SELECT range::bigint AS i, (ntile(5) OVER (ORDER BY range) - 1)::integer AS part FROM range({_NP})) SELECT part, min(i)::bigint AS start_row, (max(i) + 1)::bigint AS end_row FROM Q GROUP BY part"),
    "snap_text": (lambda t: _snap_text(t).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), f"WITH {_G} SELECT src, dst, count(*)::bigint AS n FROM G GROUP BY 1, 2"),
    "snap_ids": (lambda t: _snap_ids(t), f"WITH {_G} SELECT 1::bigint AS base, min(least(src, dst)) + 1 AS low, max(greatest(src, dst)) + 1 AS high, max(greatest(src, dst)) + 1 AS nodes FROM G"),
    "rank_vector_files": (_rank_files, f"WITH {_ranks_sql(4)} SELECT node, round(r, 10) AS rank FROM R4"),
    "meta_file": (_meta_file, f"WITH {_G} SELECT 'E' AS key, count(*)::varchar AS value FROM G UNION ALL SELECT 'N', count(*)::varchar FROM N UNION ALL SELECT 'targets', min(dst)::varchar || ',' || max(dst)::varchar FROM G"),
    "matrix_facts": (lambda t: t.a().facts().withColumn("density", F.round("density", 8)), f"WITH {_A} SELECT 'sparse' AS kind, {_NS}::bigint AS n_rows, {_NP}::bigint AS n_cols, count(*)::bigint AS stored, round(100.0::double * count(*) / ({_NS}::double * {_NP}::double), 8) AS density FROM A"),
    "report_rows": (lambda t: results.shown(_metrics(t).withColumn("total_time_s", F.col("total_time_s") * 32), ("engine", "mpi_ranks", "num_nodes", "num_edges", "iterations", "total_time_s")), f"WITH {_MET} SELECT engine, mpi_ranks::varchar AS mpi_ranks, num_nodes::varchar AS num_nodes, num_edges::varchar AS num_edges, '-' AS iterations, printf('%.4f', total_time_s * 32) AS total_time_s FROM met"),
    "parsed_numbers": (lambda t: t.orders.select("o_orderkey", scalars.number(F.substring_index("o_orderpriority", "-", 1)).alias("n"), scalars.whole("o_orderpriority").alias("none"), scalars.whole(F.col("o_totalprice").cast("string")).alias("whole"), scalars.fixed("o_orderstatus").alias("text")), "SELECT o_orderkey, coalesce(try_cast(split_part(o_orderpriority, '-', 1) AS double), 0.0::double) AS n, coalesce(floor(try_cast(o_orderpriority AS double)), 0)::bigint AS none, floor(o_totalprice)::bigint AS whole, o_orderstatus AS text FROM orders"),
    "metrics_csv": (lambda t: _metrics_csv(t).select("_ds", "engine", "mpi_ranks", "omp_threads", F.round("total_time_s", 8).alias("total_time_s"), "num_nodes"), f"WITH {_MET} SELECT _ds, engine, mpi_ranks, omp_threads, round(total_time_s, 8) AS total_time_s, num_nodes FROM met WHERE _ds = 'A'"),
    "merged_results": (lambda t: results.merged([_metrics(t).filter("_ds = 'A'"), _metrics(t).filter("_ds = 'N'").drop("num_edges")]).select("_ds", "engine", "num_edges"), f"WITH {_MET} SELECT _ds, engine, CASE WHEN _ds = 'A' THEN num_edges END AS num_edges FROM met WHERE _ds IN ('A', 'N')"),
    "numbered_runs": (lambda t: results.numbered(_metrics(t)).select("_ds", "engine", F.col("place").cast("bigint").alias("place")), f"WITH {_MET} SELECT _ds, engine, row_number() OVER (PARTITION BY _ds ORDER BY total_time_s, engine, mpi_ranks, omp_threads)::bigint AS place FROM met"),
    "result_rows": (lambda t: results.of_engine(_metrics(t), "MPI_CSR", 2, 4).select("_ds", "engine"), f"WITH {_MET} SELECT _ds, engine FROM met WHERE starts_with(engine, 'MPI_CSR') AND mpi_ranks = 2 AND omp_threads = 4"),
    "thread_speedup": (lambda t: results.speedup(_metrics(t), "CSR_Serial", "omp_threads").select("_ds", "omp_threads", F.round("speedup", 8).alias("speedup")), f"WITH {_MET}, o AS (SELECT _ds, omp_threads, total_time_s AS t FROM met WHERE starts_with(engine, 'CSR_Serial') AND mpi_ranks = 1) SELECT o._ds, o.omp_threads, round(b.t / o.t, 8) AS speedup FROM o JOIN o b ON o._ds = b._ds AND b.omp_threads = 1"),
    "memory_vs_dense": (lambda t: results.memory(_metrics(t)).select("_ds", F.round("rss_mb", 8).alias("rss_mb"), F.round("dense_mb", 8).alias("dense_mb")), f"WITH {_MET}, o AS (SELECT * FROM met WHERE starts_with(engine, 'CSR_Serial') AND mpi_ranks = 1 AND omp_threads = 1) SELECT _ds, round(mem_peak_rss_kb::double / 1024, 8) AS rss_mb, round(num_nodes::double * num_nodes::double * 8 / (1024.0::double * 1024.0::double), 8) AS dense_mb FROM o"),
    "pagerank_converged": (lambda t: _rounded(pr.pagerank(t.g(), tol=1e-4).ranks, 8), _converged_sql(60, 1e-4)),
    "pagerank_broadcast": (lambda t: _rounded(pr.pagerank(t.g(), max_iter=4, tol=0.0, strategy="broadcast").ranks), f"WITH {_ranks_sql(4)} SELECT node, round(r, 10) AS rank FROM R4"),
    "pagerank_shuffle": (lambda t: _rounded(pr.pagerank(t.g(), max_iter=4, tol=0.0, strategy="shuffle").ranks), f"WITH {_ranks_sql(4)} SELECT node, round(r, 10) AS rank FROM R4"),
    "pagerank_packed": (lambda t: _rounded(pr.pagerank(t.g(), max_iter=4, tol=0.0, strategy="packed").ranks), f"WITH {_ranks_sql(4)} SELECT node, round(r, 10) AS rank FROM R4"),
    "pagerank_hybrid": (lambda t: _rounded(pr.pagerank(t.g(), max_iter=4, tol=0.0, strategy="hybrid").ranks), f"WITH {_ranks_sql(4)} SELECT node, round(r, 10) AS rank FROM R4"),
    "pagerank_serial": (lambda t: _rounded(pr.pagerank(t.g(), max_iter=4, tol=0.0, strategy="serial").ranks), f"WITH {_ranks_sql(4)} SELECT node, round(r, 10) AS rank FROM R4"),
    "top10_match": (lambda t: t.spark.createDataFrame([(pr.top_match(_rounded(_ranks(t, 2)), _rounded(_ranks(t, 10))),)], "n bigint"), f"WITH {_ranks_sql(10)}, a AS (SELECT node, row_number() OVER (ORDER BY round(r, 10) DESC, node) AS p FROM R2), b AS (SELECT node, row_number() OVER (ORDER BY round(r, 10) DESC, node) AS p FROM R10) SELECT count(*)::bigint AS n FROM a JOIN b ON a.p = b.p AND a.node = b.node WHERE a.p <= 10"),
    "engine_metrics": (lambda t: metrics_frame(t.spark, pr.compare(t.g(), "orders", ("auto", "broadcast", "shuffle", "hybrid"), max_iter=3)).select("engine", "dataset", "num_nodes", "num_edges", "csr_nnz", "iterations", "converged", F.round("final_error", 8).alias("final_error")), f"WITH {_ranks_sql(3)} SELECT e AS engine, 'orders' AS dataset, (SELECT count(*) FROM N)::bigint AS num_nodes, (SELECT count(*) FROM G)::bigint AS num_edges, (SELECT count(*) FROM M)::bigint AS csr_nnz, 3::integer AS iterations, 'no' AS converged, (SELECT round(sum(abs(R3.r - R2.r)), 8) FROM R3 JOIN R2 ON R3.node = R2.node) AS final_error FROM (VALUES ('auto'), ('broadcast'), ('shuffle'), ('hybrid')) v(e)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in CATALOGUE.items()}


@lru_cache(1)
def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql is not None}
