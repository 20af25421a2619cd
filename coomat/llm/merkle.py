"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf, the leaves of one group (source) form a tree in the order of their keys, and the groups' subroots
form the tree of the root.  Nodes are lower-case hex SHA-256 digests; FANOUT consecutive nodes become the digest of
their joined hex, as long as more than one node is left.

A tree is cut into aligned blocks of FANOUT ** HEIGHT consecutive nodes.  In a task a block is one contiguous numpy
matrix of 64-byte rows: a level is the matrix reshaped to FANOUT digests a row and hashed row by row, and siblings of any
node are found by arithmetic on its index.  Blocks fold into their roots, which are the leaves of the next, much
smaller, tree of blocks; paths then come down the same way.  So no task holds more than a block, however large a group
is, and only keys and digests are shuffled, never texts.

Ranks: rows are range-partitioned by group and key (ties by digest, then by a number of their own, so a hot key is
split too), numbered in their partition, and a table of one row for each partition and group turns that into ranks.

Defined cases: a null value is the leaf's field ``-``; null groups come first and are a group; null keys come first in
their group; rows with equal keys are ordered by leaf, so equal rows get the places beside each other; a group with one
row has its leaf as subroot and no siblings there; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coomat.llm.tables import only, removed, settled, written

FANOUT = 3
#: Levels of a block: 2187 leaves.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*columns: Column) -> Column:
    """SHA-256 of fields as text, each as its UTF-8 length, a colon and the value, or ``-``."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


# one block, in numpy


def matrix(column: pa.Array) -> np.ndarray:
    """Hex digests as an (n, 64) matrix of bytes."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: runs of ``fanout`` rows hashed as one row each; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = [*np.ascontiguousarray(nodes[: whole * fanout]).reshape(whole, fanout * 64), *([np.ascontiguousarray(nodes[whole * fanout :]).ravel()] if whole * fanout < len(nodes) else [])]
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, 64)


def levels(nodes: np.ndarray, fanout: int, height: int | None) -> list[np.ndarray]:
    """All levels of a block up to its root: ``height`` of them in a tree that goes on above, else as many as it takes."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append(level_up(out[-1], fanout))
    return out


def siblings(nodes: np.ndarray, fanout: int) -> list[tuple[str, str]]:
    """For each node of a level what stands left and right of it in its run."""
    text, n = nodes.tobytes().decode(), len(nodes)
    at = np.arange(n)
    first = at - at % fanout
    stop = np.minimum(first + fanout, n)
    return [(text[64 * a : 64 * k], text[64 * (k + 1) : 64 * z]) for k, (a, z) in enumerate(zip(first.tolist(), stop.tolist(), strict=True))]


def paths(found: list[np.ndarray], fanout: int) -> list[list[tuple[str, str]]]:
    """For each lowest node its siblings level by level, below the block's root."""
    sides = [siblings(x, fanout) for x in found[:-1]]
    return [[s[i // fanout**k] for k, s in enumerate(sides)] for i in range(len(found[0]))]


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# trees, in Spark

_PATH = "tree string, at bigint, lefts array<string>, rights array<string>"


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows + at (place in its tree, from 0) and n (nodes of the tree)."""
    spark, names = rows.sparkSession, rows.columns
    once, folder = written(rows.withColumn("_tie", F.monotonically_increasing_id()))  # finding the ranges reads them, too
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = once.repartitionByRange(parts, tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie")
    placed, _ = written(dealt.select(*names, F.monotonically_increasing_id().alias("_id")).withColumn("_part", F.shiftright("_id", 33)))
    removed(spark, folder)
    runs = placed.groupBy(tree, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(tree, "_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    return placed.join(runs, [tree, "_part"]).select(*names, (F.col("_id") - F.col("_first") + F.col("_before")).alias("at"), "n")


def block_roots(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, at, n, digest) -> the same of the blocks: one row for each."""
    size = fanout**height

    def fold(key, table):
        table = table.sort_by("at")
        n = table["n"][0].as_py()
        root = levels(matrix(table["digest"]), fanout, height if n > size else None)[-1]
        return pa.table({"tree": [key[0].as_py()], "at": [key[1].as_py()], "n": [-(-n // size)], "digest": [root.tobytes().decode()]})

    return nodes.groupBy("tree", F.expr(f"at div {size}").alias("block")).applyInArrow(fold, "tree string, at bigint, n bigint, digest string")


def climb(nodes: DataFrame, fanout: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(tree, at, n, digest) -> (tree, at, lefts, rights: the path of each node to its tree's root) and (tree, digest: the root).

    nodes must be settled.  Each round leaves one node of fanout ** height; a tree of one node has an empty path.
    """
    size = fanout**height
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        nothing = F.array().cast("array<string>")
        return nodes.select("tree", "at", nothing.alias("lefts"), nothing.alias("rights")), nodes.select("tree", "digest")
    above, roots = climb(settled(block_roots(nodes, fanout, height)), fanout, height)

    def extend(key, table, upper):
        table = table.sort_by("at")
        found = levels(matrix(table["digest"]), fanout, height if table["n"][0].as_py() > size else None)
        own = paths(found, fanout)
        lefts, rights = upper["lefts"][0].as_py(), upper["rights"][0].as_py()
        tree = table["tree"].combine_chunks()
        return pa.table({"tree": tree, "at": table["at"].combine_chunks(), "lefts": pa.array([[x for x, _ in p] + lefts for p in own], pa.list_(pa.string())), "rights": pa.array([[x for _, x in p] + rights for p in own], pa.list_(pa.string()))})

    lower = nodes.groupBy("tree", F.expr(f"at div {size}").alias("block"))
    return lower.cogroup(above.groupBy("tree", "at")).applyInArrow(extend, _PATH), roots


def manifest(rows: DataFrame, keep: tuple[str, ...], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(keep..., tree, order, leaf, other) -> keep, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tree`` is the group as a string that sorts like it, ``order`` the key in it; ``other`` is the leaf as it was found
    later, or null where nothing is known to have changed.
    """
    size = fanout**height
    leaves = ranked(rows, "tree", ["order", "leaf"]).withColumnRenamed("leaf", "digest")
    nodes = settled(block_roots(leaves.select("tree", "at", "n", "digest"), fanout, height))
    inside, subroots = climb(nodes, fanout, height)
    subroots = settled(subroots)
    groups = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "tree", ["group"])
    groups = settled(groups)
    outside, root = climb(groups.select("tree", "at", "n", "digest"), fanout, height)
    of_group = groups.join(outside.drop("tree"), "at").select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), F.col("lefts").alias("lefts2"), F.col("rights").alias("rights2"))
    top = root.first()  # one row, or none of an empty table
    upper = inside.join(of_group, "tree").select("tree", F.col("at").alias("block"), "subroot", F.concat("lefts", "lefts2").alias("lefts"), F.concat("rights", "rights2").alias("rights"))
    root = top and top.digest
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def prove(key, table, above):
        table = table.sort_by("at")
        found = levels(matrix(table["digest"]), fanout, height if table["n"][0].as_py() > size else None)
        tail = list(zip(above["lefts"][0].as_py(), above["rights"][0].as_py(), strict=True))
        subroot = above["subroot"][0].as_py()
        proofs, folds = [], []
        for leaf, other, path in zip(table["digest"].to_pylist(), table["other"].to_pylist(), paths(found, fanout), strict=True):
            path += tail
            proofs.append(hashlib.sha256("".join(x + y for x, y in path).encode()).hexdigest())
            folds.append(folded(leaf if other is None else other, path))
        out = {k: table[k].combine_chunks() for k in keep} | {"leaf": table["digest"].combine_chunks(), "subroot": [subroot] * len(folds), "root": [root] * len(folds), "proof_sha256": proofs, "folded_root": folds}
        return pa.table(out | {"verified": [x == root for x in folds]})

    lower = leaves.groupBy("tree", F.expr(f"at div {size}").alias("block"))
    return lower.cogroup(upper.groupBy("tree", "block")).applyInArrow(prove, f"{kinds}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as the check finds it: without newlines where 2 divides the crc32 of the id; an unknown id isn't touched."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def proven_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = only(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    found = tampered(F.col("doc_id"), F.col("text"))
    other = F.when(~found.eqNullSafe(F.col("text")), digest(*fields[:-1], found))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return manifest(docs.select("doc_id", tree.alias("tree"), F.col("doc_id").alias("order"), digest(*fields).alias("leaf"), other.alias("other")), ("doc_id",))


def oracle_sql(table: str = "documents") -> str:
    """The same for DuckDB, level by level."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    head = " || ".join(map(field, FIELDS[:-1]))
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, lang, n_chars, text, coalesce('s' || source, '') AS tree FROM {table}),
hashed AS (SELECT doc_id, tree, sha256({head} || {field("text")}) AS leaf, sha256({head} || {field("late")}) AS late
  FROM (SELECT *, CASE WHEN {_crc32_even()} THEN replace(text, chr(10), '') ELSE text END AS late FROM docs)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM hashed),
up AS (SELECT 0 AS lvl, tree, pos, leaf AS d FROM leaves
  UNION ALL SELECT lvl + 1, tree, pos // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM up) WHERE c > 1 GROUP BY lvl, tree, pos // 3),
tops AS (SELECT tree, max(lvl) AS top FROM up GROUP BY tree),
subroots AS (SELECT tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM up JOIN tops USING (tree) WHERE lvl = top),
over_ AS (SELECT 0 AS lvl, pos, d FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM over_) WHERE c > 1 GROUP BY lvl, pos // 3),
roots AS (SELECT d AS root, lvl AS height FROM over_ ORDER BY lvl DESC LIMIT 1),
places AS (SELECT id, lvl, leaves.tree, leaves.pos // (3 ** lvl)::bigint AS pos FROM leaves JOIN tops USING (tree), range(40) r(lvl) WHERE lvl < top),
places2 AS (SELECT id, top + lvl AS lvl, lvl AS own, subroots.pos // (3 ** lvl)::bigint AS pos FROM leaves JOIN subroots USING (tree) JOIN tops USING (tree), roots, range(40) r(lvl) WHERE lvl < height),
sides AS (SELECT id, p.lvl, coalesce(string_agg(d, '' ORDER BY u.pos) FILTER (u.pos < p.pos), '') AS l, coalesce(string_agg(d, '' ORDER BY u.pos) FILTER (u.pos > p.pos), '') AS r
  FROM places p JOIN up u ON u.tree = p.tree AND u.lvl = p.lvl AND u.pos // 3 = p.pos // 3 GROUP BY id, p.lvl
  UNION ALL SELECT id, p.lvl, coalesce(string_agg(d, '' ORDER BY u.pos) FILTER (u.pos < p.pos), ''), coalesce(string_agg(d, '' ORDER BY u.pos) FILTER (u.pos > p.pos), '')
  FROM places2 p JOIN over_ u ON u.lvl = p.own AND u.pos // 3 = p.pos // 3 GROUP BY id, p.lvl),
folds AS (SELECT id, 0::bigint AS lvl, late AS d FROM leaves
  UNION ALL SELECT f.id, f.lvl + 1, sha256(l || d || r) FROM folds f JOIN sides s ON f.id = s.id AND f.lvl = s.lvl),
ends AS (SELECT id, arg_max(d, lvl) AS folded_root FROM folds GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256 FROM sides GROUP BY id)
SELECT doc_id, leaf, subroots.d AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) CROSS JOIN roots JOIN ends USING (id) LEFT JOIN proofs USING (id)"""


def _crc32_even() -> str:
    """The lowest bit of a crc32 is linear in the bits of the text: each bit that is set flips it or not, by its distance from the end."""
    # crc32(m) is affine over GF(2): crc(m) = crc(zeros) ^ xor of crc(bit) ^ crc(zeros), for texts of one length
    import zlib

    out = []
    for n in range(1, 21):
        zero = zlib.crc32(bytes(n)) & 1
        terms = [str(zero)]
        for k in range(n):
            mask = sum(1 << b for b in range(8) if (zlib.crc32(bytes(k) + bytes([1 << b]) + bytes(n - k - 1)) & 1) != zero)
            if mask:
                terms.append(f"bit_count(ascii(substr(doc_id::varchar, {k + 1}, 1)) & {mask})")
        out.append(f"WHEN {n} THEN ({' + '.join(terms)}) % 2 = 0")
    return f"coalesce(CASE strlen(doc_id::varchar) {' '.join(out)} END, false)"
