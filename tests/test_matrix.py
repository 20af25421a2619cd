import math

import pyarrow as pa
import pytest

from coomat.operators import multiply as mul
from coomat.operators.matrix import Matrix, Vector
from coomat.operators.partition import part_table, row_range, with_part

M34 = [(0, 0, 1), (0, 3, 2), (1, 2, 3), (2, 0, 4), (2, 3, 5)]


def cells(m):
    return sorted((r.i, r.j, r.v) for r in m.df.collect())


def test_compressed_rows_and_back(spark):
    m = Matrix.from_csr(spark, [1, 2, 3, 4, 5], [0, 3, 2, 0, 3], [0, 2, 3, 5])
    assert cells(m) == [(i, j, float(v)) for i, j, v in M34] and (m.n_rows, m.n_cols) == (3, 4)
    assert [r.ptr for r in m.row_ptr().orderBy("k").collect()] == [0, 2, 3, 5]
    c = Matrix.from_csc(spark, [1, 4, 3, 2, 5], [0, 2, 1, 0, 2], [0, 2, 2, 3, 5])
    assert cells(c) == cells(m)
    assert [r.ptr for r in c.col_ptr().orderBy("k").collect()] == [0, 2, 2, 3, 5]
    assert cells(m.by_cols().by_rows()) == cells(m)
    wide = Matrix.from_csr(spark, [1, 2], [0, 1], [0, 1, 2], n_cols=5)
    assert (wide.n_rows, wide.n_cols) == (2, 5) and mul.spmv(wide, Vector.of(spark, [1, 1, 1, 1, 1])).collect() == [1.0, 2.0]
    tall = Matrix.from_csc(spark, [1], [0], [0, 1], n_rows=4)
    assert (tall.n_rows, tall.n_cols) == (4, 1)
    for wrong in (lambda: Matrix.from_csr(spark, [1, 2], [0], [0, 2]), lambda: Matrix.from_csr(spark, [1], [3], [0, 1], n_cols=3)):
        with pytest.raises(ValueError):
            wrong()


def test_filled_needs_no_join(spark):
    m = Matrix.filled(spark, 3, 10_000, 2.0)
    assert m.df.count() == 30_000 and m.df.distinct().count() == 30_000 and Matrix.filled(spark, 3, 0).df.count() == 0
    assert "Join" not in m.df._jdf.queryExecution().executedPlan().toString()


def test_block_slice_transpose_get(spark):
    m = Matrix.from_rows(spark, list(range(1, 17)), 4, 4)
    assert [c[2] for c in cells(m.block(0, 0, 2, 2))] == [1, 2, 5, 6]
    assert cells(m.row_slice(1, 2))[0] == (0, 0, 5.0)
    assert cells(m.col_slice(2, 3))[1] == (1, 0, 7.0)
    assert cells(m.transpose())[1] == (0, 1, 5.0)
    assert m.get(3, 3) == 16.0 and Matrix.from_entries(spark, M34, 3, 4).get(1, 1) == 0.0
    for at in ((4, 0), (0, -1)):
        with pytest.raises(IndexError):
            m.get(*at)
    with pytest.raises(IndexError):
        m.block(3, 3, 2, 2)


def test_repeated_cells_are_summed(spark):
    m = Matrix.from_entries(spark, [(0, 1, 0.5), (0, 1, 0.5)], 2, 2)
    assert cells(m) == [(0, 1, 1.0)]
    assert mul.spmv(m, Vector.of(spark, [1, 1])).collect() == [1.0, 0.0]


def test_nan_and_tiny_values(spark):
    m = Matrix.from_rows(spark, [math.nan, 1.0, -0.0, 1e-16, -3.0], 1, 5)
    assert [c[2] for c in cells(m.from_dense())] == [1.0, -3.0]
    assert m.norm_max().first()[0] == 3.0 and math.isnan(m.norm_f().first()[0])
    assert not m.equals(m)
    assert Matrix.from_rows(spark, [0.0], 1, 1).equals(Matrix.from_rows(spark, [-0.0], 1, 1))


def test_equals_needs_the_shape(spark):
    a, b = Matrix.from_entries(spark, M34, 3, 4), Matrix.from_entries(spark, M34, 3, 5)
    assert a.equals(a.to_dense()) and not a.equals(b)


def test_identity_fill_info(spark):
    eye = Matrix.identity(spark, 2, 3)
    assert sum(c[2] for c in cells(eye)) == 2.0 and len(cells(eye)) == 6
    assert {c[2] for c in cells(eye.fill(4.0))} == {4.0} and {c[2] for c in cells(eye.set_zero())} == {0.0}
    assert eye.info().startswith("dense 2 x 3") and "1" in eye.show()
    assert Matrix.empty(spark, 0, 0).is_empty and Matrix.empty(spark, 0, 3).density().first()[0] == 0.0


def test_cancelled_cells_leave_no_padding(spark):
    a = Matrix.from_entries(spark, [(0, 0, 1), (0, 1, 1)], 1, 2)
    b = Matrix.from_entries(spark, [(0, 0, 2), (0, 1, 3), (1, 1, -3)], 2, 2)
    assert cells(mul.matmul(a, b)) == [(0, 0, 2.0)]


@pytest.mark.parametrize("strategy", mul.STRATEGIES)
def test_spmv_strategies_agree(spark, strategy):
    m = Matrix.from_entries(spark, [(0, 3, 2), (0, 0, 1), (2, 1, 3)], 3, 4)
    assert mul.spmv(m, Vector.of(spark, [1, 2, 3, 4]), strategy).collect() == [9.0, 0.0, 6.0]


def test_products_agree_with_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.integers(-3, 4, (7, 5)).astype(float), rng.integers(-3, 4, (5, 6)).astype(float)
    a, b = Matrix.from_rows(spark, x.ravel().tolist(), 7, 5), Matrix.from_rows(spark, y.ravel().tolist(), 5, 6)
    want = (x @ y).ravel().tolist()
    for product in (mul.matmul(a, b), mul.matmul(a.from_dense(), b), mul.matmul(a.from_dense(), b.from_dense()).to_dense(), mul.blocked_matmul(a, b, 3)):
        assert [c[2] for c in cells(product)] == want
    c = Matrix.filled(spark, 9, 6, 1.0)
    added = np.ones((9, 6))
    added[2:] += x @ y
    assert [v[2] for v in cells(mul.multiply_add(a, b, c, 2))] == added.ravel().tolist()
    per_row = [int(((x[i] != 0) @ (y != 0)).astype(bool).sum()) for i in range(7)]
    assert [r.n for r in mul.symbolic_nnz(a.from_dense(), b.from_dense()).orderBy("i").collect()] == per_row


def test_multiply_into_overwrites(spark):
    m = Matrix.from_entries(spark, [(0, 0, 2)], 2, 1)
    y = Vector.of(spark, [9, 9, 9, 9])
    assert mul.multiply_into(m, Vector.of(spark, [5]), y, 1).collect() == [9.0, 10.0, 0.0, 9.0]


def test_shapes_are_checked(spark):
    a, b = Matrix.empty(spark, 2, 3), Matrix.empty(spark, 2, 2)
    for call in (lambda: mul.matmul(a, b), lambda: mul.spmv(a, Vector.of(spark, [1])), lambda: mul.multiply_add(b, b, b, 1), lambda: mul.spmv(b, Vector.of(spark, [1, 2]), "odd")):
        with pytest.raises(ValueError):
            call()


def test_chain_order():
    assert mul.best_chain([(10, 30), (30, 5), (5, 60)]) == (4500, "((M0 M1) M2)")


def test_row_ranges(spark):
    assert [row_range(10, k, 3) for k in range(3)] == [(0, 4), (4, 7), (7, 10)]
    assert [row_range(3, k, 5) for k in range(5)] == [(0, 1), (1, 2), (2, 3), (3, 3), (3, 3)]
    assert row_range(0, 0, 2) == (0, 0)
    for rows in (1, 7, 10, 23):
        for parts in (1, 3, 5, 30):
            got = with_part(spark.range(rows).withColumnRenamed("id", "i"), rows, parts).collect()
            assert all(row_range(rows, r.part, parts)[0] <= r.i < row_range(rows, r.part, parts)[1] for r in got)
    assert [(r.start_row, r.end_row) for r in part_table(spark, 10, 3).collect()] == [(0, 4), (4, 7), (7, 10)]


def test_a_scattered_matrix_is_moved_by_no_product(spark):
    entries = [(k % 7, k % 11, float(k)) for k in range(50)]
    a = Matrix.from_entries(spark, entries, 7, 11).scatter("j")
    for x in (Vector.of(spark, [1.0] * 11), Vector.of(spark, [float(k) for k in range(11)])):
        y = mul.spmv(a, x, "shuffle")
        steps = y.df._jdf.queryExecution().executedPlan().toString()
        cells, _, _ = steps[steps.index("SortMergeJoin [j#") :].partition("InMemoryRelation")
        assert "InMemoryTableScan" in cells and "Exchange" not in cells and "Sort " not in cells
        assert y.collect() == mul.spmv(Matrix.from_entries(spark, entries, 7, 11), x).collect()
    rows = Matrix.from_entries(spark, entries, 7, 11).scatter("i")
    steps = rows.row_nnz()._jdf.queryExecution().executedPlan().toString().partition("InMemoryRelation")[0]
    assert "InMemoryTableScan" in steps and "Exchange" not in steps
    for m in (a, rows):
        m.df.unpersist()


def random_cells(seed, rows, cols, n, hot=()):
    import random

    rng = random.Random(seed)
    own = {(rng.randrange(rows), rng.randrange(cols)): float(rng.randrange(-4, 5)) for _ in range(n)}
    return {**own, **{k: float(rng.randrange(1, 5)) for k in hot}}


def plain_product(a, b):
    out = {}
    for (i, k), v in a.items():
        for (l, j), w in b.items():
            if k == l:
                out[i, j] = out.get((i, j), 0.0) + v * w
    return {k: v for k, v in out.items() if abs(v) > 1e-15}


def handle(spark, own, rows, cols):
    return Matrix.from_entries(spark, [(*k, v) for k, v in own.items()], rows, cols)


@pytest.mark.parametrize(("products", "piece"), [(1 << 20, 1 << 12), (40, 4)])
def test_two_phase_product_splits_hot_rows_and_inner_keys(spark, monkeypatch, products, piece):
    monkeypatch.setattr(mul, "PRODUCTS", products)
    monkeypatch.setattr(mul, "PIECE", piece)
    a = random_cells(1, 12, 20, 60, [(3, k) for k in range(20)] + [(i, 5) for i in range(12)])  # row 3 and inner key 5 are hot
    b = random_cells(2, 20, 15, 80, [(5, j) for j in range(15)])
    left, right = handle(spark, a, 12, 20), handle(spark, b, 20, 15)
    got = mul.matmul(left, right, "gustavson")
    assert {(r.i, r.j): r.v for r in got.df.collect()} == pytest.approx(plain_product(a, b)) and (got.n_rows, got.n_cols) == (12, 15)
    bounds = {r.i: r.bound for r in mul.product_bounds(left, right).collect()}
    assert bounds == {i: n for i in range(12) if (n := sum(1 for (r, k) in a if r == i for (l, _) in b if l == k))}
    parts = {r.i: r for r in mul.row_parts(mul.product_bounds(left, right), products).collect()}
    light = [r for r in parts.values() if r.part >= 0]
    for p in {r.part for r in light}:
        assert sum(bounds[r.i] for r in light if r.part == p) < 2 * products
    assert all(r.part == -1 - i and r.splits == -(-bounds[i] // products) for i, r in parts.items() if bounds[i] > products) and (products > 40 or parts[3].splits > 1)
    packed = mul.packed_rows(right, piece)[0].collect()
    assert sum(len(r.cols) for r in packed) == len(b) and (piece > 4 or len([r for r in packed if r.k == 5]) > 2)


def test_two_phase_product_of_nothing_and_cancelled_cells(spark):
    none = mul.matmul(Matrix.empty(spark, 3, 4), Matrix.empty(spark, 4, 2), "gustavson")
    assert cells(none) == [] and (none.n_rows, none.n_cols) == (3, 2)
    a = Matrix.from_entries(spark, [(0, 0, 1), (0, 1, 1)], 1, 2)
    assert cells(mul.matmul(a, Matrix.from_entries(spark, [(0, 0, 2), (0, 1, 3), (1, 1, -3)], 2, 2), "gustavson")) == [(0, 0, 2.0)]
    with pytest.raises(ValueError):
        mul.matmul(a, Matrix.empty(spark, 3, 2), "gustavson")


@pytest.mark.parametrize("size", [2, 5, 64])
def test_block_products(spark, size):
    a, b = random_cells(3, 11, 9, 40), random_cells(4, 9, 7, 30)
    left, right = handle(spark, a, 11, 9), handle(spark, b, 9, 7)
    sparse = mul.blocked_matmul(left, right, size)
    assert sparse.is_sparse and {(r.i, r.j): r.v for r in sparse.df.collect()} == pytest.approx(plain_product(a, b))
    dense = mul.blocked_matmul(left.to_dense(), right.to_dense(), size)
    got = {(r.i, r.j): r.v for r in dense.df.collect()}
    assert len(got) == 77 and {k: v for k, v in got.items() if v} == pytest.approx(plain_product(a, b))


@pytest.mark.parametrize("positions", [1 << 16, 4])
def test_compressed_tables_come_back(spark, monkeypatch, positions):
    from coomat.operators import matrix as mx

    monkeypatch.setattr(mx, "POSITIONS", positions)
    own = random_cells(5, 9, 8, 20, [(4, j) for j in range(8)])  # a line over several blocks, and empty lines
    m = handle(spark, {k: v for k, v in own.items() if k[0] not in (0, 6)}, 9, 8)
    stored, ptr = m.csr_tables()
    rows = stored.orderBy("pos").collect()
    want = sorted((r.i, r.j, r.v) for r in m.df.collect())
    assert [(r.pos, r["index"], r.value) for r in rows] == [(p, j, v) for p, (_, j, v) in enumerate(want)]
    back = Matrix.from_csr_tables(stored, ptr, 8)
    assert cells(back) == cells(m) and (back.n_rows, back.n_cols) == (9, 8)
    back = Matrix.from_csc_tables(*m.csc_tables(), 9)
    assert cells(back) == cells(m) and (back.n_rows, back.n_cols) == (9, 8)


def test_compressed_tables_are_checked(spark):
    stored = spark.createDataFrame([(0, 1.0, 2), (1, 2.0, 0)], "pos bigint, value double, index bigint")
    ptr = lambda *p: spark.createDataFrame(list(enumerate(p)), "k bigint, ptr bigint")
    assert cells(Matrix.from_csr_tables(stored, ptr(0, 0, 2), 3)) == [(1, 0, 2.0), (1, 2, 1.0)]
    for bad in (ptr(0, 1), ptr(1, 2), ptr(0, 2, 1, 2), ptr(0), ptr(), ptr(0, 2).selectExpr("k * 2 AS k", "ptr")):
        with pytest.raises(ValueError):
            Matrix.from_csr_tables(stored, bad, 3)
    with pytest.raises(ValueError):
        Matrix.from_csr_tables(stored, ptr(0, 2), 2)
    assert cells(Matrix.from_csr_tables(stored.limit(0), ptr(0, 0), 2)) == []
    values = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos bigint, value double")
    assert cells(Matrix.from_values(values, 2, 1)) == [(0, 0, 1.0), (1, 0, 2.0)]
    with pytest.raises(ValueError):
        Matrix.from_values(values, 2, 2)


def test_grid_is_never_broadcast(spark):
    m = Matrix.sparse(spark.range(40).selectExpr("id % 9 AS i", "id % 5 AS j", "1.0 AS v"), 9, 12)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        steps = m.to_dense().from_dense().df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in steps and "Broadcast" not in steps
        assert cells(m.to_dense().from_dense()) == cells(m)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dense_products_of_any_number_of_rows(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(mul, "DENSE_ROWS", 3)
    monkeypatch.setattr(mul, "SEGMENT", 4)
    own = random_cells(6, 30, 11, 60)
    m, full = handle(spark, own, 31, 11), np.zeros((31, 11))
    for k, v in own.items():
        full[k] = v
    for odd in ((), ((2, np.nan),), ((3, np.inf), (10, -np.inf))):
        x = np.arange(1.0, 12.0)
        for k, v in odd:
            x[k] = v
        with np.errstate(invalid="ignore"):
            want = (full * x).sum(axis=1)
        assert np.array_equal(mul.spmv(m, Vector.of(spark, x.tolist()), "dense").collect(), want, equal_nan=True)


def test_block_products_are_summed_in_their_task(spark, monkeypatch):
    a, b = random_cells(7, 6, 40, 90), random_cells(8, 40, 3, 60)
    for held in (1 << 22, 1):
        monkeypatch.setattr(mul, "HELD", held)
        product = mul.blocked_matmul(handle(spark, a, 6, 40).scatter("j", 1), handle(spark, b, 40, 3).scatter("i", 1), 4)
        assert {(r.i, r.j): r.v for r in product.df.collect()} == pytest.approx(plain_product(a, b))


def test_mismatches_join_nothing(spark):
    a = Matrix.from_entries(spark, [(0, 0, 1), (0, 1, float("nan")), (1, 0, -0.0), (1, 1, 4)], 2, 2)
    b = Matrix.from_entries(spark, [(0, 0, 1), (0, 1, float("nan")), (1, 1, 5)], 2, 2)
    n = a.mismatches(b)
    assert n.first().n == 2 and "Join" not in n._jdf.queryExecution().executedPlan().toString()


def test_two_phase_product_sends_a_piece_to_a_part_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(mul, "CHUNK", 7)
    own = random_cells(9, 20, 15, 120, [(i, 5) for i in range(20)])
    a = handle(spark, own, 20, 15).scatter("j")
    seen = []
    monkeypatch.setattr(mul, "row_parts", lambda bounds, n, f=mul.row_parts: seen.append(n) or f(bounds, n))
    got = mul.matmul(a, a.transpose(), "gustavson")
    assert {(r.i, r.j): r.v for r in got.df.collect()} == pytest.approx(plain_product(own, {(j, i): v for (i, j), v in own.items()}))
    assert seen == [mul.PRODUCTS]  # one part: every inner index is one row of the join, for all its cells
    batch = pa.record_batch({"rows": [[1, 2], [3]], "lefts": [[1.0, 2.0], [3.0]], "cols": [[4, 5, 6, 7], []], "vals": [[1.0] * 4, []]}, pa.schema([("rows", pa.list_(pa.int64())), ("lefts", pa.list_(pa.float64())), ("cols", pa.list_(pa.int64())), ("vals", pa.list_(pa.float64()))]))
    for part in (batch, batch.slice(0, 1)):
        i, c, x = map(np.concatenate, zip(*mul.expanded(part), strict=True))
        assert i.tolist() == [1] * 4 + [2] * 4 and c.tolist() == [4, 5, 6, 7] * 2 and x.tolist() == [1.0] * 4 + [2.0] * 4


def shuffled(spark, run):
    """MB that the stages of run wrote to shuffles."""
    context = spark.sparkContext
    scala, as_java = context._jsc.sc(), context._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    none = context._gateway.new_array(context._jvm.double, 0)

    def written():
        scala.listenerBus().waitUntilEmpty(10_000)
        return {x.stageId(): x.shuffleWriteBytes() for x in as_java(scala.statusStore().stageList(None, False, False, none, None))}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before) / 1e6


def test_two_phase_product_sends_few_copies_of_cells_that_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(mul, "PRODUCTS", 4000)  # many parts, and hardly two cells of one of them share an inner index
    monkeypatch.setattr(mul, "LARGEST", 1)
    own = {(i, k): float((i + k) % 50) for k in range(1000) for i in {(k * 7919 + m * 104729 + m * m * 31 * k) % 997 for m in range(20)}}
    a = handle(spark, own, 997, 1000).scatter("j")
    a.df.count()
    got = []
    assert shuffled(spark, lambda: got.extend(mul.matmul(a, a.transpose(), "gustavson").df.collect())) < 0.95
    by_column = {}
    for (i, k), v in own.items():
        by_column.setdefault(k, []).append((i, v))
    want = {}
    for held in by_column.values():
        for i, v in held:
            for j, w in held:
                want[i, j] = want.get((i, j), 0.0) + v * w
    assert {(r.i, r.j): r.v for r in got} == {k: v for k, v in want.items() if v}


def test_two_phase_product_in_tiles_with_columns_too_long_for_one(spark, monkeypatch):
    monkeypatch.setattr(mul, "PRODUCTS", 60)
    monkeypatch.setattr(mul, "RESIDENT", 10)
    monkeypatch.setattr(mul, "STREAMED", 40)
    a = random_cells(10, 40, 30, 300, [(3, k) for k in range(30)])
    b = random_cells(11, 30, 300, 900, [(k, 7) for k in range(30)])  # over 63 groups of columns, and column 7 in none of them
    got = mul.matmul(handle(spark, a, 40, 30), handle(spark, b, 30, 300), "gustavson")
    found = [(r.i, r.j, r.v) for r in got.df.collect()]
    assert len(found) == len({x[:2] for x in found}) and {(i, j): v for i, j, v in found} == pytest.approx(plain_product(a, b))


@pytest.mark.parametrize("far", [0, 1 << 40])
def test_tiles_hold_the_right_side_and_take_parts_one_by_one(monkeypatch, far):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(mul, "CHUNK", 16)
    monkeypatch.setattr(mul, "DEALT", 50)
    a, b = random_cells(12, 12, 20, 130), random_cells(13, 20, 15, 120)
    a |= {(2, 4): float("inf"), (3, 5): 0.1, (4, 6): -0.0, (5, 7): 40000.0}
    side = lambda cells, part: [pa.record_batch({"part": [part(x) for x, _, _ in some], "x": [x for x, _, _ in some], "k": [k * (far + 1) for _, k, _ in some], "v": [v for *_, v in some], "to": [3] * len(some)}) for at in range(0, len(cells), 20) for some in [cells[at : at + 20]]]
    lefts = list(mul.dealt(side([(i, k, v) for (i, k), v in a.items()], lambda i: i // 3), 2, 2, 2))
    rights = list(mul.dealt(side([(j, k, v) for (k, j), v in b.items()], lambda j: j % 2), 2, 2, 0))
    rows = sorted((r for x in (*lefts, *rights) for r in x.to_pylist()), key=lambda r: (r["tile"], r["part"]))
    assert {r["tile"] for r in rows} == {0, 1, 2, 3} and {r["part"] for r in rows} == {-1, 0, 1, 2, 3}
    got = [r for x in mul.tile_sums([pa.RecordBatch.from_pylist(rows[:9], lefts[0].schema), pa.RecordBatch.from_pylist(rows[9:], lefts[0].schema)]) for r in x.to_pylist()]
    want = plain_product(a, b)
    assert len(got) == len({(r["i"], r["j"]) for r in got}) and {(r["i"], r["j"]): r["v"] for r in got if abs(r["v"]) > 1e-15} == pytest.approx(want)
    for x in ([1, 2, 3], [0], [-5, 1 << 40], [0.0, 1.5], [float("nan")], [-0.0, 3.0], [3e4, -7.0], [4e4]):
        x = np.array(x)
        y = mul.grown(pa.scalar(mul.shrunk(x), pa.binary()))
        assert np.array_equal(x, y, equal_nan=x.dtype == np.float64) and np.array_equal(np.signbit(x), np.signbit(y))
    by = np.array([7, -3, 7, 1 << 61, 0])
    assert [y.tolist() for y in mul.in_order(by)] == [[-3, 0, 7, 7, 1 << 61], [1, 4, 0, 2, 3]]


def test_block_products_of_cells_that_lie_apart_join_panels(spark, monkeypatch):
    own = {(k * 7919 % 30011, k * 104729 % 2003): float(k % 9 - 4) for k in range(20000)}
    right = {(k, j): float(k % 7 + j) for k in range(2003) for j in range(2)}
    a, b = handle(spark, own, 30011, 2003), handle(spark, right, 2003, 2)
    frames = []
    monkeypatch.setattr(type(a.df), "mapInArrow", lambda df, *args, run=type(a.df).mapInArrow: frames.append(df) or run(df, *args))
    got = mul.blocked_matmul(a, b, 8).df.collect()
    want = {}
    for (i, k), v in own.items():
        for j in range(2):
            want[i, j] = want.get((i, j), 0.0) + v * right[k, j]
    assert {(r.i, r.j): r.v for r in got} == {k: v for k, v in want.items() if v}
    joined = [df.count() for df in frames if "Join" in df._jdf.queryExecution().optimizedPlan().toString()]
    assert len(joined) == 1 and 251 <= joined[0] < 1000  # some pieces of 251 panels, not 20,000 blocks of a cell each


@pytest.mark.parametrize("most", [3, 100])
def test_packed_blocks_hold_every_cell_once(spark, monkeypatch, most):
    own = random_cells(14, 50, 20, 300, [(i, 7) for i in range(50)]) | {(1, 1): 0.25}
    cells = handle(spark, own, 50, 20).df.selectExpr("j div 4 AS key", "i AS x", "cast(j % 4 AS int) AS p", "v")
    rows = mul.packed_blocks(cells, most).collect()
    found = {}
    for r in rows:
        x, p, v = (mul.grown(pa.scalar(bytes(c), pa.binary())).tolist() for c in (r.x, r.p, r.v))
        assert x == sorted(x) and 0 < len(x) <= most
        found |= {(i, r.key * 4 + j): y for i, j, y in zip(x, p, v, strict=True)}
    assert found == own and sum(len(mul.grown(pa.scalar(bytes(r.x), pa.binary()))) for r in rows) == len(own)


def test_block_products_of_rows_that_are_filled_some_at_a_time(spark, monkeypatch):
    for size, held in ((4, 1), (5, 1 << 23)):
        monkeypatch.setattr(mul, "HELD", held)
        monkeypatch.setattr(mul, "FILLED", 3 * size)
        monkeypatch.setattr(mul, "PANEL_ROWS", 17)
        a, b = random_cells(15, 90, 23, 500), random_cells(16, 23, 11, 90)
        product = mul.blocked_matmul(handle(spark, a, 90, 23), handle(spark, b, 23, 11), size)
        found = [(r.i, r.j, r.v) for r in product.df.collect()]
        assert len(found) == len({x[:2] for x in found}) and {(i, j): v for i, j, v in found} == pytest.approx(plain_product(a, b))
