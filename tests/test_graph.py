import numpy as np
import pytest

from coomat.operators import packed
from coomat.operators import pagerank as pr
from coomat.operators.spent import Spent, measured
from coomat.plans import results
from coomat.sources import metrics, vectors
from coomat.sources.graph import Graph, dataset_name, parse_edges, read_snap
from coomat.streaming.degrees import stream_edges, stream_out_degree


def graph_of(spark, tmp_path, text, **how):
    path = tmp_path / "g.txt"
    path.write_text(text)
    return read_snap(spark, str(path), **how)


def numpy_ranks(edges, n, d=0.85, tol=1e-6, most=100):
    deg = np.bincount([a for a, _ in edges], minlength=n)
    m = np.zeros((n, n))
    for a, b in edges:
        m[b, a] += 1 / deg[a]
    r = np.full(n, 1 / n)
    for k in range(1, most + 1):
        new = d * (m @ r) + (d * r[deg == 0].sum() + 1 - d) / n
        err, r = np.abs(new - r).sum(), new
        if err < tol:
            break
    return r, k


@pytest.mark.parametrize(("text", "n", "dangling"), [("# c\n1\t2\n2 3\n", 3, [2]), ("0 1\n1 2\n", 3, [2]), ("0 1\n1 5\n", 6, [2, 3, 4, 5])])
def test_bases_and_gaps(spark, tmp_path, text, n, dangling):
    g = graph_of(spark, tmp_path, text)
    assert g.n == n and sorted(r.node for r in g.dangling().collect()) == dangling


def test_odd_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("12", "7,8", " # x", "a b", "", "7 8 9", "10-5", "+3 4", "1\t2\r", "# 1 2")], "value string")
    assert sorted((r.src, r.dst) for r in parse_edges(lines).collect()) == [(1, 2), (3, 4), (7, 8), (10, -5)]
    with pytest.raises(ValueError):
        Graph.of(parse_edges(lines))


def test_no_edges(spark, tmp_path):
    with pytest.raises(ValueError):
        graph_of(spark, tmp_path, "# nothing\n")


def test_parallel_edges(spark, tmp_path):
    g = graph_of(spark, tmp_path, "0 1\n0 1\n0 2\n")
    assert {(r.i, r.j): round(r.v, 9) for r in g.transition().df.collect()} == {(1, 0): 0.666666667, (2, 0): 0.333333333}
    assert g.out_degree().first().deg == 3


@pytest.mark.parametrize("strategy", pr.STRATEGIES)
def test_pagerank_agrees_with_numpy(spark, strategy):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 25, 120), rng.integers(0, 30, 120), strict=True)]
    want, steps = numpy_ranks(edges, 30)
    g = Graph.of(spark.createDataFrame(edges, "src bigint, dst bigint"), base=0, n=30)
    done = pr.pagerank(g, strategy=strategy)
    got = np.array([r["rank"] for r in done.ranks.orderBy("node").collect()])
    assert np.abs(got - want).sum() < 1e-12 and done.stats.iterations == steps and done.stats.converged
    assert [r.node for r in pr.top_k(done.ranks, 3).collect()] == np.lexsort((np.arange(30), -want))[:3].tolist()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_engines_have_plans_of_their_own(spark, monkeypatch):
    g = Graph.of(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "src bigint, dst bigint"))
    cells = spark.createDataFrame([(0, 1, 0.5)], "src bigint, dst bigint, v double")
    ranks, hot = spark.createDataFrame([(0, 0.5)], "src bigint, rank double"), spark.createDataFrame([], "src bigint, parts int")
    dealt = cells.withColumn("salt", cells.src.cast("int") * 0)
    assert "BroadcastHashJoin" in plan(pr.flows([dealt], ranks, hot, "broadcast")) and "SortMergeJoin" not in plan(pr.flows([dealt], ranks, hot, "broadcast"))
    assert "SortMergeJoin" in plan(pr.flows([dealt], ranks, hot, "shuffle"))
    both = plan(pr.flows([dealt, dealt], ranks, hot.select("src"), "hybrid"))
    assert both.count("SortMergeJoin") == 1 and "BroadcastHashJoin" in both and "Union" in both
    local = plan(pr.local_steps(cells, 3, 0.85, 5, 0.0))
    assert "MapInArrow" in local and "Coalesce 1" in local and "MapInArrow" not in plan(pr.flows([dealt], ranks, hot, "broadcast"))
    used = []
    for name in ("_packed", "_local", "_distributed"):
        monkeypatch.setattr(pr, name, lambda g, c, way, *a, f=getattr(pr, name): used.append(way) or f(g, c, way, *a))
    pr.pagerank(g, max_iter=1)
    monkeypatch.setattr(pr, "LOCAL_CELLS", 2)
    pr.pagerank(g, max_iter=1)
    monkeypatch.setattr(pr, "BROADCAST_ROWS", 2)
    pr.pagerank(g, max_iter=1)
    assert used == ["packed", "packed", "hybrid"]
    skipped = {}
    assert [r["engine"] for r in pr.compare(g, "x", ("serial", "packed", "shuffle", "broadcast"), skipped=skipped, max_iter=1)] == ["shuffle"]
    assert set(skipped) == {"serial", "packed", "broadcast"} and pr.summary([], skipped).count("SKIP") == 3


def test_packed_rows_are_in_all_tasks_and_stay_there(spark, monkeypatch):
    for name, size in (("BLOCK", 40), ("LEAST", 1)):
        monkeypatch.setattr(packed, name, size)
    rng = np.random.default_rng(2)
    cells = {(int(i), int(j)): float(v) for i, j, v in zip(np.where(rng.random(900) < 0.5, 7, rng.integers(0, 60, 900)), rng.integers(0, 50, 900), rng.random(900), strict=True)}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "i bigint, j bigint, v double")
    want, x = np.zeros((60, 50)), rng.random(50)
    for k, v in cells.items():
        want[k] = v
    for gathered in (10**6, 1):  # partial sums on the driver, and added before
        monkeypatch.setattr(packed, "GATHERED", gathered)
        m = packed.Packed.of(frame, 60, 50, len(cells))
        y, seconds = m.multiply(x)
        assert np.abs(y - want @ x).max() < 1e-12 and seconds > 0
        sizes = [r.n // 4 for r in m.blocks.selectExpr("octet_length(cols) n").collect()]
        assert len(sizes) > 8 and max(sizes) < 2 * 40 and sum(sizes) == len(cells)
        steps = plan(packed.partial_sums(m.blocks, spark.sparkContext.broadcast(x)))
        assert "InMemoryTableScan" in steps and "Exchange" not in steps.split("InMemoryRelation")[0] and "Coalesce" not in steps
        m.drop()
    assert packed.Packed.of(frame.limit(0), 3, 2, 0).multiply(np.ones(2))[0].tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        packed.pack(frame, 5, packed.BROADCAST_ROWS + 1, 1)


def test_light_cells_of_hybrid_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(pr, "HEAVY", 3)
    seen = []
    monkeypatch.setattr(pr, "flows", lambda kept, ranks, hot, way, f=pr.flows: seen.append((kept, hot, plan(f(kept, ranks, hot, way)))) or f(kept, ranks, hot, way))
    edges = [(0, b) for b in range(1, 30)] + [(a, 0) for a in range(5, 30)] + [(3, 4), (3, 4)]
    want, _ = numpy_ranks(edges, 30)
    done = pr.pagerank(Graph(spark.createDataFrame(edges, "src bigint, dst bigint"), 30), strategy="hybrid")
    assert np.abs(np.array([r["rank"] for r in done.ranks.orderBy("node").collect()]) - want).sum() < 1e-12
    (light, heavy), hot, steps = seen[0]
    assert [r.src for r in hot.collect()] == [0] and {r.src for r in heavy.collect()} == {0} and light.filter("src = 0").count() == 0
    cells, _, _ = steps[steps.index("SortMergeJoin") :].partition("InMemoryRelation")
    assert "InMemoryTableScan" in cells and "Exchange" not in cells and "Sort " not in cells


@pytest.mark.parametrize("strategy", pr.STRATEGIES)
def test_no_edges_at_all(spark, strategy):
    done = pr.pagerank(Graph(spark.createDataFrame([], "src bigint, dst bigint"), 4), strategy=strategy)
    assert [tuple(r) for r in done.ranks.orderBy("node").collect()] == [(k, 0.25) for k in range(4)] and done.stats.converged


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_hot_nodes_are_salted(spark, monkeypatch, strategy):
    monkeypatch.setattr(pr, "HOT", 5)
    edges = [(a, 0) for a in range(1, 30)] + [(0, b) for b in range(1, 30)] + [(3, 4), (3, 4)]
    want, _ = numpy_ranks(edges, 30)
    done = pr.pagerank(Graph.of(spark.createDataFrame(edges, "src bigint, dst bigint"), base=0, n=30), strategy=strategy)
    assert np.abs(np.array([r["rank"] for r in done.ranks.orderBy("node").collect()]) - want).sum() < 1e-12
    row = done.stats.row("x")
    assert 0 <= row["comm_pct"] < 100 and row["comm_pct"] + row["comp_pct"] == pytest.approx(100) and done.stats.mpi_ranks > 1


def test_times_of_tasks(spark):
    spent = Spent()
    with measured(spark, spent):
        spark.range(200_000).selectExpr("id % 1000 AS k", "id").groupBy("k").sum("id").repartition(3, "k").count()
    assert 0 < spent.moving < spent.tasks and 0 < spent.share_moving < 1
    other = Spent()
    with measured(spark, other):
        pass
    assert other.tasks == 0 and other.share_moving == 0.0


def test_not_converged_and_compare(spark):
    g = Graph.of(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2)], "src bigint, dst bigint"))
    done = pr.pagerank(g, max_iter=2)
    assert not done.stats.converged and done.stats.iterations == 2
    rows = pr.compare(g, "tiny", ("auto", "dense"), done.ranks, max_iter=2)
    assert all(r["l1_vs_ref"] < 1e-12 and r["top10_match"] == 3 and r["converged"] == "no" for r in rows)
    assert len(rows[0]) == 28 and list(rows[0]) == [n for n, _ in metrics.COLUMNS]
    with pytest.raises(ValueError):
        pr.pagerank(g, strategy="odd")


def test_files(spark, tmp_path):
    ranks = spark.createDataFrame([(0, 0.25), (1, 0.75)], "node bigint, rank double")
    assert vectors.write_rank_vector(ranks, str(tmp_path / "r.bin")) == 2
    assert sorted(map(tuple, vectors.read_rank_vector(spark, str(tmp_path / "r.bin")).collect())) == [(0, 0.25), (1, 0.75)]
    vectors.write_meta(spark.createDataFrame([("N", "2"), ("top10", "1:0.75")], "key string, value string"), str(tmp_path / "m.txt"))
    assert dict(map(tuple, vectors.read_meta(spark, str(tmp_path / "m.txt")).collect())) == {"N": "2", "top10": "1:0.75"}
    g = Graph.of(spark.createDataFrame([(0, 1)], "src bigint, dst bigint"))
    rows = metrics.metrics_frame(spark, pr.compare(g, "x", ("auto",), max_iter=1))
    metrics.write_metrics(rows, str(tmp_path / "out"))
    back = metrics.read_tagged(spark, {"x": str(tmp_path / "out")})
    assert back.count() == 1 and back.first()._ds == "x"
    assert "auto" in results.terminal(back) and "## All runs" in results.report(back) and results.report(back).splitlines()[4].count("|") == 15
    assert [[r.engine for r in results.ordered(back.union(back.withColumn("engine", metrics.F.lit("z")).withColumn("mpi_ranks", metrics.F.lit(0))), by).collect()] for by in results.ORDERS][:2] == [["auto", "z"], ["z", "auto"]]
    assert "## auto" in results.report(back) and results.best_config(back).count() == 1
    assert dataset_name("/a/soc.v1.txt") == "soc.v1"


def test_rank_vectors_in_files_and_splits(spark, tmp_path, monkeypatch):
    values = np.random.default_rng(3).random(1000)
    ranks = spark.createDataFrame(list(enumerate(values.tolist())), "node bigint, rank double").repartition(5)
    folder = str(tmp_path / "r")
    for _ in range(2):  # again over the same files
        assert vectors.write_rank_vector(ranks, folder, 64) == 1000
    assert len([x for x in (tmp_path / "r").iterdir() if x.suffix == ".bin"]) == 16 and b"".join(x.read_bytes() for x in sorted((tmp_path / "r").glob("*.bin"))) == values.astype("<f8").tobytes()
    assert sorted(map(tuple, vectors.read_rank_vector(spark, folder).collect())) == list(enumerate(values.tolist()))
    one = tmp_path / "one.bin"
    one.write_bytes(values.astype("<f8").tobytes() + b"123")
    assert sorted(map(tuple, vectors.read_rank_vector(spark, str(one)).collect())) == list(enumerate(values.tolist()))
    one.write_bytes(values.astype("<f8").tobytes())
    monkeypatch.setattr(vectors, "WHOLE", 100)  # as if it were too large for one value
    assert sorted(map(tuple, vectors.read_rank_vector(spark, str(one)).collect())) == list(enumerate(values.tolist()))
    with pytest.raises(ValueError):
        vectors.read_rank_vector(spark, folder)
    one.write_bytes(b"1" * 801)
    with pytest.raises(ValueError):
        vectors.read_rank_vector(spark, str(one))
    (tmp_path / "two").mkdir()
    for name in ("a", "b"):
        (tmp_path / "two" / name).write_bytes(b"123456789")
    with pytest.raises(ValueError):
        vectors.read_rank_vector(spark, str(tmp_path / "two"))
    assert vectors.write_rank_vector(ranks.limit(0), str(tmp_path / "none")) == 0
    with pytest.raises(ValueError):
        vectors.write_rank_vector(ranks.filter("node <> 5"), str(tmp_path / "gap"))


def test_timer_and_stream(spark, tmp_path):
    t = pr.Timer()
    t.start("a")
    assert t.stop("a") >= 0 and t.get("none") == 0.0 and t.lines().startswith("a: ") and pr.vm_kb() >= pr.rss_kb() > 0
    folder = tmp_path / "edges"
    folder.mkdir()
    (folder / "1.txt").write_text("0 1\n0 2\n# c\n1 2\n")
    q = stream_out_degree(stream_edges(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("deg").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("deg").collect())) == [(0, 2), (1, 1)]


def test_serial_does_larger_graphs_as_auto_does(spark, monkeypatch):
    edges = [(a, (a * 7 + 1) % 12) for a in range(9)] + [(2, 3), (2, 3)]
    g = Graph(spark.createDataFrame(edges, "src bigint, dst bigint"), 12)
    want, _ = numpy_ranks(edges, 12)
    for name in ("LOCAL_CELLS", "BROADCAST_ROWS"):
        monkeypatch.setattr(pr, name, 2)
        done = pr.pagerank(g, strategy="serial")
        assert np.abs(np.array([r["rank"] for r in done.ranks.orderBy("node").collect()]) - want).sum() < 1e-12
        assert done.stats.mpi_ranks > 1 and done.stats.converged


def test_engines_share_the_edges_and_none_is_left_out_unasked(spark, monkeypatch):
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 2), (0, 2)], "src bigint, dst bigint"), 4)
    calls = []
    monkeypatch.setattr(pr, "counted_cells", lambda g, f=pr.counted_cells: calls.append(1) or f(g))
    monkeypatch.setattr(pr, "BROADCAST_ROWS", 2)
    engines = ("auto", "broadcast", "packed", "serial")
    rows = pr.compare(g, "x", engines, max_iter=3)
    assert [r["engine"] for r in rows] == list(engines) and len(calls) == 1 and len({round(r["final_error"], 12) for r in rows}) == 1


def test_packed_ranks_stay_in_the_executors(spark, monkeypatch):
    for module, name, size in ((packed, "SIDE", 8), (pr, "SIDE", 8), (packed, "TILE", 20), (packed, "LEAST", 1)):
        monkeypatch.setattr(module, name, size)
    seen = []
    monkeypatch.setattr(pr, "tile_sums", lambda held, subs, pieces, f=pr.tile_sums: seen.append((held.selectExpr("octet_length(cols) n").collect(), plan(f(held, subs, pieces)))) or f(held, subs, pieces))
    monkeypatch.setattr(pr, "piece_of", packed.piece_of)
    collected = []
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: collected.append(self))
    edges = [(0, b) for b in range(1, 60)] + [(a, 9) for a in range(20, 50)] + [(3, 4), (3, 4)]
    want, steps = numpy_ranks(edges, 61)
    done = pr.pagerank(Graph(spark.createDataFrame(edges, "src bigint, dst bigint"), 61), strategy="packed")
    got = np.array([r["rank"] for r in done.ranks.orderBy("node").collect()])
    assert len(got) == 61 and np.abs(got - want).sum() < 1e-12 and done.stats.iterations == steps and not collected
    sizes = [r.n // 4 for r in seen[0][0]]
    assert sum(sizes) == len(set(edges)) and max(sizes) < 40 and len(sizes) > 5
    moved, _, _ = seen[0][1][seen[0][1].index("SortMergeJoin") :].partition("InMemoryRelation")
    assert "InMemoryTableScan" in moved and "Exchange" not in moved
