"""Matrix and vector handles: coordinate DataFrames plus a shape.

A matrix is (i bigint, j bigint, v double).  Sparse ones hold some of the cells, dense ones all.  A vector is
(i bigint, v double) with every index.  Coordinates that occur more than once are summed when a sparse matrix is made,
so every operator sees one value a cell.  Shapes can't be seen in sparse rows, so they live in the handle and are
checked before any job runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coomat.operators.partition import scattered, with_positions

#: Values up to this size count as zero where dense becomes sparse and in sparse products.
EPS = 1e-15

#: Positions of a block where lines of compressed tables meet their cells.
POSITIONS = 1 << 16


def nonzero(v: Column, eps: float = EPS) -> Column:
    """abs(v) > eps as IEEE has it: never true for NaN (Spark orders NaN above every number)."""
    return ~F.isnan(v) & (F.abs(v) > eps)


def span(spark: SparkSession, n: int, name: str = "i") -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    n: int

    @classmethod
    def dense(cls, df: DataFrame, n: int) -> Vector:
        """Fills missing indices with 0.0."""
        spark = df.sparkSession
        own = df.select(F.col("i").cast("bigint").alias("i"), F.col("v").cast("double").alias("v"))
        return cls(span(spark, n).join(own, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v")), n)

    @classmethod
    def of(cls, spark: SparkSession, values: list[float]) -> Vector:
        return cls(spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i bigint, v double"), len(values))

    def collect(self) -> list[float]:
        return [r.v for r in self.df.orderBy("i").collect()]


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    n_rows: int
    n_cols: int
    is_sparse: bool = True

    # construction

    @classmethod
    def sparse(cls, df: DataFrame, n_rows: int, n_cols: int) -> Matrix:
        """From (i, j, v) rows in any order; repeated cells are summed."""
        own = df.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
        return cls(own.groupBy("i", "j").agg(F.sum("v").alias("v")), n_rows, n_cols)

    @classmethod
    def empty(cls, spark: SparkSession, n_rows: int, n_cols: int) -> Matrix:
        return cls(spark.createDataFrame([], "i bigint, j bigint, v double"), n_rows, n_cols)

    @classmethod
    def from_entries(cls, spark: SparkSession, entries: list[tuple], n_rows: int, n_cols: int) -> Matrix:
        return cls.sparse(spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in entries], "i bigint, j bigint, v double"), n_rows, n_cols)

    @classmethod
    def from_csr(cls, spark: SparkSession, values: list[float], col_idx: list[int], row_ptr: list[int], n_cols: int | None = None) -> Matrix:
        """From compressed rows; the columns of a row need no order.  Without n_cols the last column that is used is the last."""
        return cls._compressed(spark, values, col_idx, row_ptr, n_cols, True)

    @classmethod
    def from_csc(cls, spark: SparkSession, values: list[float], row_idx: list[int], col_ptr: list[int], n_rows: int | None = None) -> Matrix:
        """From compressed columns, alike."""
        return cls._compressed(spark, values, row_idx, col_ptr, n_rows, False)

    @classmethod
    def _compressed(cls, spark, values, other, ptr, size, by_row):
        if len(values) != len(other) or not ptr or ptr[-1] != len(values):
            raise ValueError("lengths of values, indices and pointers don't fit")
        used = max(other, default=-1) + 1
        size = used if size is None else size
        if used > size:
            raise ValueError(f"index {used - 1} lies outside {size}")
        flat = spark.createDataFrame([(list(map(float, values)), list(map(int, other)), list(map(int, ptr)))], "vals array<double>, o array<bigint>, p array<bigint>")
        # line k owns positions p[k] to p[k + 1] - 1
        lines = flat.select("vals", "o", "p", F.posexplode(F.slice("p", 1, len(ptr) - 1)).alias("k", "lo"))
        held = lines.withColumn("hi", F.expr("p[k + 1]")).filter("hi > lo").select("k", "vals", "o", F.explode(F.expr("sequence(lo, hi - 1)")).alias("at"))
        cells = held.select(F.col("k").cast("bigint").alias("k"), F.expr("o[cast(at as int)]").alias("o"), F.expr("vals[cast(at as int)]").alias("v"))
        i, j = ("k", "o") if by_row else ("o", "k")
        shape = (len(ptr) - 1, size) if by_row else (size, len(ptr) - 1)
        return cls.sparse(cells.select(F.col(i).alias("i"), F.col(j).alias("j"), "v"), *shape)

    @classmethod
    def from_csr_tables(cls, stored: DataFrame, ptr: DataFrame, n_cols: int) -> Matrix:
        """From compressed rows of any size: stored (pos, value, index) and ptr (k, ptr), one row more than the matrix has.

        Line k owns positions ptr(k) to ptr(k + 1) - 1.  Both tables are cut into blocks of POSITIONS, lines at each block
        they reach, and in a block every position takes the last line that begins at or before it: a merge in order of
        position, so no pairs are tried, and a long line lies in as many tasks as it has blocks.
        """
        return cls._tables(stored, ptr, n_cols, True)

    @classmethod
    def from_csc_tables(cls, stored: DataFrame, ptr: DataFrame, n_rows: int) -> Matrix:
        """From compressed columns, alike."""
        return cls._tables(stored, ptr, n_rows, False)

    @classmethod
    def _tables(cls, stored: DataFrame, ptr: DataFrame, size: int, by_row: bool) -> Matrix:
        own = ptr.select(F.col("k").cast("bigint").alias("k"), F.col("ptr").cast("bigint").alias("lo"))
        lines = own.join(own.select((F.col("k") - 1).alias("k"), F.col("lo").alias("hi")), "k")
        n, low, high, used, least = stored.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos"), F.max("index"), F.min("index")).first()
        count, first, last = own.agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
        start, end, shortest, gaps = lines.agg(F.min("lo"), F.max("hi"), F.min(F.col("hi") - F.col("lo")), F.count(F.lit(1))).first()
        if not count or first or last != count - 1 or gaps != count - 1:
            raise ValueError("pointers must be numbered from 0 without gaps")
        if start or (end or 0) != n or (shortest or 0) < 0 or n and (low or high != n - 1):
            raise ValueError("lengths of values, indices and pointers don't fit")
        if n and (used >= size or least < 0):
            raise ValueError(f"index {used if used >= size else least} lies outside {size}")
        block = lambda x: F.floor(x / POSITIONS).cast("bigint")
        reached = lines.filter("hi > lo").select("k", "lo", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))).alias("b"))
        starts = reached.select("b", F.greatest("lo", F.col("b") * POSITIONS).alias("at"), F.lit(0).alias("cell"), "k", F.lit(None).cast("bigint").alias("o"), F.lit(None).cast("double").alias("v"))
        cells = stored.select(block(F.col("pos")).alias("b"), F.col("pos").cast("bigint").alias("at"), F.lit(1).alias("cell"), F.lit(None).cast("bigint").alias("k"), F.col("index").cast("bigint").alias("o"), F.col("value").cast("double").alias("v"))
        seen = Window.partitionBy("b").orderBy("at", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = starts.unionAll(cells).withColumn("k", F.last("k", ignorenulls=True).over(seen)).filter("cell = 1")
        i, j = ("k", "o") if by_row else ("o", "k")
        return cls.sparse(found.select(F.col(i).alias("i"), F.col(j).alias("j"), "v"), *((count - 1, size) if by_row else (size, count - 1)))

    def csr_tables(self) -> tuple[DataFrame, DataFrame]:
        """(pos, value, index) and (k, ptr) of the compressed rows: the same matrix for ``from_csr_tables``."""
        return with_positions(self.df, "i", "j").select("pos", F.col("v").alias("value"), F.col("j").alias("index")), self.row_ptr()

    def csc_tables(self) -> tuple[DataFrame, DataFrame]:
        return with_positions(self.df, "j", "i").select("pos", F.col("v").alias("value"), F.col("i").alias("index")), self.col_ptr()

    @classmethod
    def from_values(cls, values: DataFrame, n_rows: int, n_cols: int) -> Matrix:
        """Dense, from (pos, value) in row order; a position tells row and column, so nothing is moved."""
        n, low, high = values.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos")).first()
        if n != n_rows * n_cols or n and (low or high != n - 1):
            raise ValueError(f"{n} values for {n_rows} x {n_cols}")
        width = max(1, n_cols)
        return cls(values.select(F.expr(f"cast(pos div {width} as bigint)").alias("i"), F.expr(f"cast(pos % {width} as bigint)").alias("j"), F.col("value").cast("double").alias("v")), n_rows, n_cols, False)

    @classmethod
    def filled(cls, spark: SparkSession, n_rows: int, n_cols: int, value: float = 0.0) -> Matrix:
        """All cells of one value, made row by row in blocks of columns: no join and nothing to broadcast."""
        block = 1 << 12
        if not n_cols:
            return cls(spark.createDataFrame([], "i bigint, j bigint, v double"), n_rows, 0, False)
        blocks = span(spark, n_rows).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n_cols - 1) // block))))
        cells = blocks.select("i", F.explode(F.sequence(F.col("b") * block, F.least(F.col("b") * block + block, F.lit(n_cols)) - 1)).alias("j"))
        return cls(cells.withColumn("v", F.lit(float(value))), n_rows, n_cols, False)

    @classmethod
    def from_rows(cls, spark: SparkSession, values: list[float], n_rows: int, n_cols: int) -> Matrix:
        """Dense, from values in row order."""
        if len(values) != n_rows * n_cols:
            raise ValueError(f"{len(values)} values for {n_rows} x {n_cols}")
        flat = spark.createDataFrame([(list(map(float, values)),)], "a array<double>").select(F.posexplode("a").alias("p", "v"))
        return cls(flat.select(F.expr(f"cast(p div {max(1, n_cols)} as bigint)").alias("i"), F.expr(f"cast(p % {max(1, n_cols)} as bigint)").alias("j"), "v"), n_rows, n_cols, False)

    @classmethod
    def identity(cls, spark: SparkSession, n_rows: int, n_cols: int) -> Matrix:
        full = cls.filled(spark, n_rows, n_cols)
        return full._with(full.df.withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))

    def _with(self, df: DataFrame, n_rows: int | None = None, n_cols: int | None = None, is_sparse: bool | None = None) -> Matrix:
        return Matrix(df, self.n_rows if n_rows is None else n_rows, self.n_cols if n_cols is None else n_cols, self.is_sparse if is_sparse is None else is_sparse)

    # conversion

    def from_dense(self, eps: float = EPS) -> Matrix:
        """Sparse: cells with abs(v) > eps."""
        return self._with(self.df.filter(nonzero(F.col("v"), eps)), is_sparse=True)

    def to_dense(self) -> Matrix:
        """All cells.  The grid is made by rows and joined with the cells there are; a dense matrix is kept as it is.

        The planner takes the grid for as small as its column of row numbers, so it is told not to broadcast it.
        """
        if not self.is_sparse:
            return self
        grid = Matrix.filled(self.df.sparkSession, self.n_rows, self.n_cols).df.select("i", "j").hint("merge")
        return self._with(grid.join(self.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), is_sparse=False)

    def by_rows(self, parts: int | None = None) -> Matrix:
        """Compressed-row layout: rows together, in order."""
        dealt = self.df.repartition(parts, "i") if parts else self.df.repartition("i")
        return self._with(dealt.sortWithinPartitions("i", "j"))

    def by_cols(self, parts: int | None = None) -> Matrix:
        dealt = self.df.repartition(parts, "j") if parts else self.df.repartition("j")
        return self._with(dealt.sortWithinPartitions("j", "i"))

    def scatter(self, by: str = "i", parts: int | None = None) -> Matrix:
        """Dealt by row ("i") or column ("j") once and kept in the executors, so products that meet it there move it no more.

        Sums by row need it by "i", joins on the inner index as the left side by "j".  ``df.unpersist()`` lets it go.
        """
        return self._with(scattered(self.df, by, parts=parts))

    def set_zero(self) -> Matrix:
        return self.fill(0.0)

    def fill(self, value: float) -> Matrix:
        return Matrix.filled(self.df.sparkSession, self.n_rows, self.n_cols, value)

    def row_ptr(self) -> DataFrame:
        """(k, ptr), n_rows + 1 rows."""
        return self._ptr("i", self.n_rows)

    def col_ptr(self) -> DataFrame:
        return self._ptr("j", self.n_cols)

    def _ptr(self, by: str, n: int) -> DataFrame:
        """Running sums in two steps, so no window holds more than a block of lines."""
        block = 1 << 16
        counts = self.df.groupBy(F.col(by).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        lines = span(self.df.sparkSession, n + 1, "k").join(counts, "k", "left").select("k", F.coalesce("c", F.lit(0)).alias("c"), F.expr(f"k div {block}").alias("b"))
        before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        blocks = lines.groupBy("b").agg(F.sum("c").alias("s")).select("b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        return lines.withColumn("p", F.coalesce(F.sum("c").over(within), F.lit(0))).join(blocks, "b").select("k", (F.col("p") + F.col("base")).alias("ptr"))

    # access

    @property
    def size(self) -> int:
        return self.n_rows * self.n_cols

    @property
    def is_empty(self) -> bool:
        return self.size == 0

    @property
    def is_square(self) -> bool:
        return self.n_rows == self.n_cols

    def get(self, i: int, j: int) -> float:
        """One cell; 0.0 where a sparse matrix has none."""
        if not (0 <= i < self.n_rows and 0 <= j < self.n_cols):
            raise IndexError(f"({i}, {j}) is outside {self.n_rows} x {self.n_cols}")
        return self.element(i, j).first().v

    def element(self, i: int, j: int) -> DataFrame:
        return self.df.filter((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))

    def block(self, r0: int, c0: int, rows: int, cols: int) -> Matrix:
        if r0 < 0 or c0 < 0 or r0 + rows > self.n_rows or c0 + cols > self.n_cols:
            raise IndexError("the block leaves the matrix")
        inside = (F.col("i") >= r0) & (F.col("i") < r0 + rows) & (F.col("j") >= c0) & (F.col("j") < c0 + cols)
        return self._with(self.df.filter(inside).select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), rows, cols)

    def row_slice(self, start: int, stop: int) -> Matrix:
        return self.block(start, 0, stop - start, self.n_cols)

    def col_slice(self, start: int, stop: int) -> Matrix:
        return self.block(0, start, self.n_rows, stop - start)

    def transpose(self) -> Matrix:
        return self._with(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n_cols, self.n_rows)

    def mismatches(self, other: Matrix) -> DataFrame:
        """One row: cells that differ (n).  Missing sparse cells are 0.0; NaN equals nothing.

        Both sides are grouped by cell together: a join would sort both in one task.
        """
        fill = lambda c: F.coalesce(F.max(c), F.lit(0.0)).alias(c)  # noqa: E731 - of one value or none
        none = F.lit(None).cast("double")
        both = self.df.select("i", "j", F.col("v").alias("a"), none.alias("b")).unionAll(other.df.select("i", "j", none.alias("a"), F.col("v").alias("b")))
        x, y = F.col("a"), F.col("b")
        return both.groupBy("i", "j").agg(fill("a"), fill("b")).agg(F.coalesce(F.sum(((x != y) | F.isnan(x) | F.isnan(y)).cast("bigint")), F.lit(0)).alias("n"))

    def equals(self, other: Matrix) -> bool:
        return (self.n_rows, self.n_cols) == (other.n_rows, other.n_cols) and self.mismatches(other).first().n == 0

    def info(self) -> str:
        kind = "sparse" if self.is_sparse else "dense"
        stored = self.nnz().first().nnz
        return f"{kind} {self.n_rows} x {self.n_cols}, {stored} stored, density {100.0 * stored / self.size if self.size else 0.0:.4f} %"

    def facts(self) -> DataFrame:
        """What ``info`` says, as one row: kind, n_rows, n_cols, stored, density."""
        shape = [F.lit("sparse" if self.is_sparse else "dense").alias("kind"), F.lit(self.n_rows).cast("bigint").alias("n_rows"), F.lit(self.n_cols).cast("bigint").alias("n_cols")]
        return self.nnz().select(*shape, F.col("nnz").alias("stored"), (F.lit(100.0) * F.col("nnz") / F.lit(float(self.size or 1))).alias("density"))

    def show(self, rows: int = 20, cols: int = 10) -> str:
        """The top left corner as text."""
        cells = {(r.i, r.j): r.v for r in self.df.filter((F.col("i") < rows) & (F.col("j") < cols)).collect()}
        lines = [" ".join(f"{cells.get((i, j), 0.0):10.4g}" for j in range(min(cols, self.n_cols))) + (" ..." if self.n_cols > cols else "") for i in range(min(rows, self.n_rows))]
        return "\n".join(lines + ["..."] * (self.n_rows > rows))

    # aggregates

    def nnz(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("nnz"))

    def row_nnz(self) -> DataFrame:
        return self.df.groupBy("i").agg(F.count(F.lit(1)).alias("n"))

    def col_nnz(self) -> DataFrame:
        return self.df.groupBy("j").agg(F.count(F.lit(1)).alias("n"))

    def density(self) -> DataFrame:
        """Stored cells in per cent; 0 for an empty shape."""
        return self.df.agg((F.lit(100.0) * F.count(F.lit(1)) / F.lit(float(self.size or 1)) * F.lit(float(self.size > 0))).alias("density"))

    def norm_f(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("norm_f"))

    def norm_max(self) -> DataFrame:
        """Largest abs(v); NaN is passed over."""
        return self.df.agg(F.coalesce(F.max(F.when(~F.isnan("v"), F.abs("v"))), F.lit(0.0)).alias("norm_max"))
