"""The Merkle manifest against a plain recursion, block sizes that cut trees in every way, and odd tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coomat.llm import merkle

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def tree_of(nodes):
    """All levels, each node with its index."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def steps(levels, at):
    for level in levels[:-1]:
        run = at - at % 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(b"" if r[3] is None else b"s" + r[3].encode(), []).append((r[0] is not None, r[0], leaf_of(r, r[1]), r))
    trees = {g: (sorted(x, key=lambda y: (y[0], y[1] or 0, y[2])), None) for g, x in groups.items()}
    trees = {g: (x, tree_of([y[2] for y in x])) for g, (x, _) in trees.items()}
    top = tree_of([trees[g][1][-1][0] for g in sorted(trees)])
    out = []
    for k, g in enumerate(sorted(trees)):
        ordered, levels = trees[g]
        for at, (_, _, leaf, r) in enumerate(ordered):
            path = [*steps(levels, at), *steps(top, k)]
            late = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            fold = leaf_of(r, late)
            for left, right in path:
                fold = sha(*left, fold, *right)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], sha(*(x for left, right in path for x in (*left, *right))), fold, fold == top[-1][0]))
    return out


def corpus(n=90, seed=5):
    rng = random.Random(seed)
    rows = [(k, rng.choice([None, "", "a\nb", "é\n\n☃", "x"]), rng.choice(["en", None]), rng.choice(["hot"] * 5 + ["b", "é", None, ""]), rng.choice([None, 3])) for k in rng.sample(range(10_000), n)]
    rows += [(None, "n\n", "en", "hot", 1), (None, None, None, None, None), (7, "long\n" * 40_000, "en", "alone", 1), *[(5, "same\n", "en", "hot", 5)] * 7, *[(5, "other", "en", "hot", 5)] * 2]
    return rows


def plain(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("height", "groups"), [(1, False), (2, False), (7, False), (1, True)])
def test_equals_a_plain_recursion(spark, monkeypatch, height, groups):
    rows = corpus()
    if groups:  # more groups than a block holds
        rows = [(r[0], r[1], r[2], f"g{k % 23}", r[4]) for k, r in enumerate(rows)]
    monkeypatch.setattr(merkle.manifest, "__defaults__", (3, height))
    got = merkle.proven_documents(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert plain(got.collect()) == plain(brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, "a\n", "en", "s", 2)], [(1, "a", "en", "s", 2), (2, "b", "en", "t", 1)]])
def test_small_tables(spark, rows):
    got = merkle.proven_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert plain(got) == plain(brute(rows) if rows else [])


def test_other_columns_and_partitions_change_nothing(spark):
    rows = corpus(40)
    docs = spark.createDataFrame(rows, SCHEMA)
    other = docs.select("*", *(F.lit(1).alias(c) for c in ("leaf", "tree", "at", "n", "DIGEST", "order", "_tie"))).repartition(7)
    assert plain(merkle.proven_documents(other).collect()) == plain(merkle.proven_documents(docs).collect())


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = c.sql(entry.oracle_sql()["op12_merkle_manifest"]).df()
    got = entry.queries()["op12_merkle_manifest"](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.astype(object).values.tolist())
    assert got.filter("not verified").count() == sum(not v for v in want.verified) > 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_blocks_by_index_arithmetic(n):
    nodes = [sha(str(k)) for k in range(n)]
    found = merkle.levels(np.frombuffer("".join(nodes).encode(), np.uint8).reshape(-1, 64), 3, None)
    assert [["".join(map(chr, r)) for r in level] for level in found] == tree_of(nodes)
    for at, path in enumerate(merkle.paths(found, 3)):
        assert path == [("".join(a), "".join(b)) for a, b in steps(tree_of(nodes), at)] and merkle.folded(nodes[at], path) == tree_of(nodes)[-1][0]
    tall = merkle.levels(found[0], 3, 6)
    assert len(tall) == 7 and (n == 1 or "".join(map(chr, tall[len(found) - 1][0])) == tree_of(nodes)[-1][0])
