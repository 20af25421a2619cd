"""Operator 5: set-similarity self-join of documents on their word shingles.

A document's set holds the distinct 5-word shingles of its whole text (one shingle of the whole sequence if it
has fewer words).  Two sets link when 100 * |A & B| >= 75 * |A | B|.  The steps:

1. A count sketch of all shingles (2**20 counters, summed over all documents) fixes one global rare-first order.
   Any order gives right results; rare-first keeps common passages out of the prefixes.
2. Each set sends the first n - ceil(0.75 n) + 1 shingles in that order (its prefix).  Two sets that link share one.
3. Prefix shingles are dealt to buckets and meet there.  Equal sets are one node, so exact copies never pair.
   Pairs must pass the length filter and the positional filter.  Within a bucket only pairs with a leader are made
   (a star), never all pairs.  A shingle that the sketch shows to be frequent beyond its slot's share is salted by set:
   its parts meet in buckets of their own, so no task holds a hot shingle's sets, and step 5 joins the parts.
4. Pairs pass the suffix filter (bit sketches bound the Hamming distance of two sets from below) and are
   verified once, on the exact sets of the few documents that take part.
5. Connected components.  A bucket whose sets are by now all in one component is done.  In the others first the
   leaders of the components meet, then all pairs across the components that are left, in cells: a large group is
   cut into parts by set, and each two parts (and each part alone) meet in a task of their own.  So every two sets of
   a shingle meet, whatever its frequency, and no link is lost.

Defined cases: a null or blank text has an empty set, links with nothing and is its own component; a null doc_id
takes part in links but is the component id only where no document of the component has an id; repeated rows are
equal sets; other columns are not read; an empty table gives an empty one.  Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coomat.llm import kernels as K
from coomat.llm.components import components
from coomat.llm.tables import aside, compact, maybe_in, membership, only, settled

SKETCH_BITS = 20
CHUNK = 1 << 12
#: Least bits of the suffix filter's sketches; larger sets have at least two bits a shingle.
BITS = 2048
#: A shingle counted so often beyond its slot's share is dealt in several parts.
SALT_OVER = 1 << 16
#: A group goes on in rows of at most so many of the sets that it has.
MEMBERS = 4096
#: At most so many sets are one part of a cell.
CELL = 1 << 14
#: So many leaders take turns over the shingles of a group.
LEADERS = 3
MEMBER = np.dtype([("fp", "<i8"), ("n", "<u4"), ("pos", "<u4")])
ENTRY = np.dtype([("token", "<u8"), ("pos", "<u4"), ("fp", "<i8"), ("n", "<u4")])
#: Candidates meet on the high 48 bits of a shingle's hash; the verification has all 64.
TOKEN = np.uint64(0xFFFFFFFFFFFF0000)


def sketch(texts: DataFrame, n: int) -> np.ndarray:
    """How often the shingles of each of 2**SKETCH_BITS slots occur in all texts; a table of fixed size."""
    total = 1 << SKETCH_BITS

    def count(batches):
        counts = np.zeros(total, np.int64)
        for b in batches:
            for _, hashes, _ in K.slice_shingles(b.column(0), n):
                counts += np.bincount((hashes >> K.U(64 - SKETCH_BITS)).astype(np.int64), minlength=total)
        part, chunks = TaskContext.get().partitionId(), counts.reshape(-1, CHUNK)
        narrow = np.min_scalar_type(int(counts.max(initial=0)))
        blobs = [c.astype(narrow).tobytes() for c in chunks]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([part // 64] * len(chunks), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "some", "counts"])

    def add(key, batch):
        out = np.zeros(CHUNK, np.int64)
        for x in batch.column("counts"):
            x = x.as_py()
            out += np.frombuffer(x, f"<u{len(x) // CHUNK}").astype(np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out.astype(np.min_scalar_type(int(out.max(initial=0)))).tobytes()], pa.binary())})

    parts = texts.mapInArrow(count, "chunk int, some int, counts binary")
    some = parts.groupBy("chunk", "some").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros((total // CHUNK, CHUNK), np.int64)
    for r in some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():  # total / CHUNK rows
        out[r.chunk] = np.frombuffer(r.counts, f"<u{len(r.counts) // CHUNK}")
    return out.ravel()


def parts_of(counts: np.ndarray) -> np.ndarray:
    """Into how many parts the shingles of each slot are dealt.  Twice the median is what light shingles add up to."""
    usual = 2 * int(np.median(counts)) if len(counts) else 0
    return (1 + np.maximum(0, counts - usual) // SALT_OVER).astype(np.uint32)


def part(tokens: np.ndarray, fps: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of its shingle that a set belongs to."""
    return K.mix(fps.astype(K.U) + K.U(3)) % parts[slot(tokens)].astype(K.U)


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> K.U(64 - SKETCH_BITS)).astype(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit hash of a set; 0 is the empty set."""
    if not len(s):
        return 0
    x = np.array([K.mix(s).sum(dtype=K.U) + K.U(len(s)), np.bitwise_xor.reduce(s)], K.U)
    return int(K.mix(K.mix(x[:1]) + x[1:]).view(np.int64)[0]) or 1


def doc_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, text) -> (doc_id, key, n, fp, bits)."""

    def run(batches):
        for b in batches:
            sizes, prints, sketches = [], [], []
            for s in K.doc_shingles(b.column("text"), n):
                sizes.append(len(s))
                prints.append(fingerprint(s))
                sketches.append(bit_sketch(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "key", "n", "fp", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key bigint, n int, fp bigint, bits binary")


def bit_sketch(s: np.ndarray) -> bytes:
    """The size, and one bit for each of a power of two of slots of the hashes: whether the slot has an odd number.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    slots = max(BITS, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s & K.U(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.array([len(s)], "<u8").tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketches (rows of 64-bit words) that the same sets have with fewer slots."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(one: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: whether the least difference of two sets leaves overlap enough.  Rows are sketches."""
    total = (one[0] + others[:, 0]).astype(np.int64)
    words = min(len(one), others.shape[1]) - 1
    apart = np.bitwise_count(folded(one[None, 1:], words) ^ folded(others[:, 1:], words)).sum(1, dtype=np.int64)
    return (total - apart) * (100 + percent) >= 2 * percent * total


def prefix(s: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set: as many as two linked sets can't all differ in, in the global order."""
    size = len(s)
    p = size - (percent * size + 99) // 100 + 1 if size else 0
    f = order[slot(s)]
    if p < size:  # only the prefix needs its exact order
        some = np.flatnonzero(f <= np.partition(f, p - 1)[p - 1])
        s, f = s[some], f[some]
    return s[np.lexsort((s, f))[:p]]


def packed(e: np.ndarray) -> bytes:
    """Entries byte plane by byte plane, which leaves the empty high bytes to the shuffle's compression."""
    return np.ascontiguousarray(e.view(np.uint8).reshape(-1, ENTRY.itemsize).T).tobytes()


def unpacked(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY).ravel()


def dealt(docs: DataFrame, counts, salts, buckets: int, n: int, percent: int) -> DataFrame:
    """Prefix entries of all documents as packed blocks (bucket, block); a task sends each distinct set once."""

    def flush(held):
        fps, ns, tokens = held
        lens = np.array([len(x) for x in tokens])
        e = np.zeros(int(lens.sum()), ENTRY)
        e["token"] = np.concatenate(tokens) & TOKEN
        e["fp"], e["n"] = np.repeat(np.array(fps, np.int64), lens), np.repeat(np.array(ns, np.uint32), lens)
        e["pos"] = np.arange(len(e)) - np.repeat(np.cumsum(lens) - lens, lens)
        own = part(e["token"], e["fp"], salts.value)
        bucket = (K.mix(e["token"] + own) % K.U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        e, at = e[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed(e[at[k] : at[k + 1]]) for k in full], pa.binary())], ["bucket", "block"])

    def deal(batches):
        seen, held, size = set(), ([], [], []), 0
        for b in batches:
            for s in K.doc_shingles(b.column("text"), n):
                fp = fingerprint(s)
                if not fp or fp in seen:
                    continue
                seen.add(fp)
                for x, y in zip(held, (fp, len(s), prefix(s, counts.value, percent)), strict=True):
                    x.append(y)
                size += len(held[2][-1])
                if size > 2 << 20:
                    yield flush(held)
                    held, size = ([], [], []), 0
        if size:
            yield flush(held)

    return docs.select("text").mapInArrow(deal, "bucket int, block binary")


def possible(a, b, percent: int) -> np.ndarray:
    """Length and positional filter: the overlap that a shared shingle at these positions still allows."""
    na, nb, pa_, pb = (np.asarray(x).astype(np.int64) for x in (a["n"], b["n"], a["pos"], b["pos"]))
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (most * (100 + percent) >= percent * (na + nb))


def meet(blocks: DataFrame, salts, percent: int) -> DataFrame:
    """(bucket, block) -> rows: pairs with a leader (a, b), and groups of three sets and more (a, members).

    A group goes by the hash of its members, a: copies share many shingles, and one of those groups does for all,
    because the filters' bounds hold at every shared shingle.  b is that shingle; large groups have several rows.
    Of a salted shingle every part has its rows (size > 0, the members in the row); there a is the xor of their hashes.
    """
    names = ["a", "b", "members", "size"]

    def rows_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        held = [unpacked(x.as_py()) for b in batches for x in b.column("block")]
        e = np.concatenate(held) if held else np.zeros(0, ENTRY)
        held.clear()
        if len(e):  # shingles of one set alone go first: they are most
            by = np.argsort(e["token"], kind="stable")
            key = e["token"][by]
            same = key[1:] == key[:-1]
            salted = salts.value[slot(key)] > 1
            e = e[by[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | salted]]
        if not len(e):
            return
        lead = K.mix(e["fp"].astype(K.U) ^ K.mix((e["token"] >> K.U(16)) % K.U(LEADERS) + K.U(7)))
        own = part(e["token"], e["fp"], salts.value)
        by = np.lexsort((lead, own, e["token"]))
        e, own = e[by], own[by]
        apart = (e["token"][1:] != e["token"][:-1]) | (own[1:] != own[:-1])
        new = np.concatenate([[True], apart | (e["fp"][1:] != e["fp"][:-1])])  # a set sent by several tasks counts once
        first = np.concatenate([[True], apart])[new]
        e = e[new]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(e)))
        leader = np.repeat(at, size)
        a, b = e[leader], e
        ok = ~first & possible(a, b, percent)
        lo, hi = np.minimum(a["fp"], b["fp"])[ok], np.maximum(a["fp"], b["fp"])[ok]
        pairs = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
        salted = salts.value[slot(e["token"][at])] > 1
        inner = K.mix(e["fp"].astype(K.U))
        sums = np.concatenate([[0], np.cumsum(inner, dtype=K.U)]).astype(K.U)
        name = K.mix(sums[at + size] - sums[at] + K.mix(size.astype(K.U)))
        one = np.flatnonzero((size > 2) & ~salted)
        one = one[np.unique(name[one], return_index=True)[1]]
        members = np.zeros(len(e), MEMBER)
        for x in ("fp", "n", "pos"):
            members[x] = e[x]
        for x in range(0, len(pairs), 50_000):
            p = pairs[x : x + 50_000]
            k = len(p)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names)
        rows, of = [], 0
        for i in np.concatenate([one, np.flatnonzero(salted)]).tolist():
            start, stop, token = int(at[i]), int(at[i] + size[i]), int(e["token"][at[i]].view(np.int64))
            for lo in range(start, stop, MEMBERS):
                hi = min(lo + MEMBERS, stop)
                if salted[i]:
                    rows.append((int(np.bitwise_xor.reduce(inner[lo:hi]).view(np.int64)), token, members[lo:hi].tobytes(), hi - lo))
                else:
                    rows.append((int(name[i].view(np.int64)), token, members[lo:hi].tobytes(), 0))
                of += hi - lo
                if of > 200_000:
                    yield rows_of(rows)
                    rows, of = [], 0
        if rows:
            yield rows_of(rows)

    return blocks.mapInArrow(run, "a bigint, b bigint, members binary, size bigint")


def groups_of(met: DataFrame) -> DataFrame:
    """(a, members) of the groups, each once; the parts of a salted shingle are one group under one name."""
    held = met.filter("size = 0")
    plain = held.join(held.groupBy("a").agg(F.min("b").alias("b")), ["a", "b"], "left_semi").select("a", "members")
    salted = met.filter("size > 0")
    whole = salted.groupBy("b").agg(F.bit_xor("a").alias("x"), F.sum("size").alias("n")).filter("n > 1")
    named = whole.groupBy("x", "n").agg(F.min("b").alias("b")).select("b", F.xxhash64("x", "n").alias("name"))
    return plain.union(salted.select("b", "members").join(named, "b").select("name", "members"))


def entries_of(groups: DataFrame) -> DataFrame:
    """(a, members) -> (token, fp, n, pos); the group's name stands for its shingle."""

    def run(batches):
        for b in batches:
            for name, blob in zip(b.column("a").to_pylist(), b.column("members"), strict=True):
                m = np.frombuffer(blob.as_py(), MEMBER)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), name, np.int64)), pa.array(m["fp"].copy()), pa.array(m["n"].astype(np.int32)), pa.array(m["pos"].astype(np.int32))], ["token", "fp", "n", "pos"])

    return groups.mapInArrow(run, "token bigint, fp bigint, n int, pos int")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(text) -> (fp, data): the whole sorted sets, each once a task."""

    def rows(prints, data):
        return pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(data, pa.binary())], ["fp", "data"])

    def run(batches):
        seen, prints, data, size = set(), [], [], 0
        for b in batches:
            for s in K.doc_shingles(b.column("text"), n):
                fp = fingerprint(s)
                if fp and fp not in seen:
                    seen.add(fp)
                    prints.append(fp)
                    data.append(s.tobytes())
                    size += s.nbytes
                if size > 16 << 20:
                    yield rows(prints, data)
                    prints, data, size = [], [], 0
        yield rows(prints, data)

    return docs.select("text").mapInArrow(run, "fp bigint, data binary")


def passing(pairs: DataFrame, data: DataFrame, what: str, percent: int) -> DataFrame:
    """Pairs (a, b) whose overlap is large enough: the bound that sketches give (bits), or the overlap of the sets (set).

    The data of both ends go to the place of the first, sorted so that a task holds one set at a time.  A first end of
    very many pairs has several places.
    """
    places = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("_k"))
    placed = pairs.join(places, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_k")).cast("int").alias("s"))
    ends = placed.select(F.col("b").alias("fp"), "a", "s").union(placed.select(F.col("a").alias("fp"), "a", "s").distinct())
    rows = data.select("fp", "data").join(ends, "fp").select("a", "s", "fp", "data")

    def run(batches):
        key, mine = None, None
        for b in batches:
            a, keep = b.column("a").to_pylist(), []
            for i, (x, s, y) in enumerate(zip(a, b.column("s").to_pylist(), b.column("fp").to_pylist(), strict=True)):
                value = b.column("data")[i].as_py()
                value = np.frombuffer(value, "<u8")
                if x == y:
                    key, mine = (x, s), value
                    keep.append(False)
                    continue
                assert key == (x, s)
                if what == "bits":
                    keep.append(bool(may_link(mine, value[None], percent)[0]))
                    continue
                at = np.searchsorted(mine, value)
                both, total = int((mine[np.minimum(at, len(mine) - 1)] == value).sum()), len(mine) + len(value)
                keep.append(both * (100 + percent) >= percent * total)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("fp")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = (F.col("a") != F.col("fp")).alias("o")
    return compact(rows.select("*", first).repartition("a", "s").sortWithinPartitions("a", "s", "o").select("a", "s", "fp", "data").mapInArrow(run, "a bigint, b bigint").distinct())


def in_cells(entries: DataFrame, tasks: int, data: DataFrame | None = None) -> DataFrame:
    """The entries under tokens of their own cells, dealt by these, with the sets' ``data`` if it is given.

    A group of more than CELL entries is cut into parts by set; a cell holds two parts (or one), so every two entries
    of a group are together in some cell, and no cell has more than about two CELL entries.
    """
    large = entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_g")).filter("_g > 1")
    spread = entries.join(large, "token", "left").withColumn("_p", F.pmod(F.xxhash64("fp", F.lit(5)), F.coalesce("_g", F.lit(1))))
    spread = spread.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_g", F.lit(1)) - 1)))
    cell = F.when(F.col("_g").isNull(), F.col("token")).otherwise(F.xxhash64("token", F.least("_p", "_q"), F.greatest("_p", "_q")))
    spread = compact(spread.withColumn("token", cell).drop("_g", "_p", "_q"))
    tasks = int(max(tasks, spread.count() // 100_000))
    return (spread if data is None else spread.join(data, "fp")).repartition(tasks, "token")


def across(entries: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Entries (token, fp, n, pos, label[, data]) dealt by token -> all pairs across labels that pass every filter.

    This is the exact way for buckets that the leaders left with several components.  Pairs are tried set by set and
    only those that the length, positional and suffix filters let through are made.  Without ``pairs``: only the sets
    that have a partner by length and position, as (fp).
    """

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        token, fp, label = (table.column(x).to_numpy() for x in ("token", "fp", "label"))
        e = {"n": table.column("n").to_numpy(), "pos": table.column("pos").to_numpy()}
        names, one, doc = np.unique(fp, return_index=True, return_inverse=True)
        if pairs:
            bits = [np.frombuffer(table.column("data")[i].as_py(), "<u8") for i in one]
            width = np.array([len(x) for x in bits])
        kinds, kind, size = np.unique(label, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(kinds))
        rank = rank[kind]  # the set of the smaller component looks for those of larger ones
        by = np.lexsort((rank, token))
        token, rank, doc, e = token[by], rank[by], doc[by], {k: v[by] for k, v in e.items()}
        start = np.searchsorted(token, token)
        key = np.concatenate([[True], (token[1:] != token[:-1]) | (rank[1:] != rank[:-1])])
        stop = np.maximum.accumulate(np.where(key, np.arange(len(token)), 0))  # rows of larger components end here
        order = np.argsort(doc, kind="stable")
        at = np.searchsorted(doc[order], np.arange(len(names) + 1))
        found, some_pair = [], np.zeros(len(names), bool)

        def made():
            out = np.array(found, np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

        for d in range(len(names)):
            near = []
            for i in order[at[d] : at[d + 1]]:
                lo, hi = start[i], stop[i]
                if hi > lo:
                    others = {x: v[lo:hi] for x, v in e.items()}
                    near.append(doc[lo:hi][possible({x: v[i] for x, v in e.items()}, others, percent)])
            if near:
                near = np.unique(np.concatenate(near))
                if not pairs:
                    some_pair[near] = True
                    some_pair[d] |= len(near) > 0
                    continue
                for x in range(0, len(near), 4096):
                    for w in np.unique(width[near[x : x + 4096]]):
                        some = near[x : x + 4096][width[near[x : x + 4096]] == w]
                        found.extend((min(names[d], y), max(names[d], y)) for y in names[some[may_link(bits[d], np.stack([bits[k] for k in some]), percent)]])
                    if len(found) > 100_000:
                        yield made()
        if not pairs:
            yield pa.RecordBatch.from_arrays([pa.array(names[some_pair])], ["fp"])
            return
        yield made()

    return entries.mapInArrow(run, "a bigint, b bigint" if pairs else "fp bigint").distinct()


def similar_documents(docs: DataFrame, n: int = K.SHINGLE, percent: int = 75) -> DataFrame:
    """(doc_id, text, ...) -> one row per document: doc_id, key (hash of doc_id and text), group, n_shingles, component_id.

    group names the component whether it has ids or not.

    component_id is the smallest doc_id of the documents that links reach, the document's own included.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    counted = sketch(docs.select("text"), n)
    counts, salts = (spark.sparkContext.broadcast(x) for x in (counted, parts_of(counted)))  # 2**SKETCH_BITS numbers
    sets = settled(doc_sets(docs, n))
    ids = settled(sets.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.first("bits").alias("data")))
    entries = (sets.agg(F.sum("n").alias("s")).first().s or 0) * (100 - percent) // 100
    tasks = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // (1 << 20)))
    blocks = dealt(docs, counts, salts, 8 * tasks, n, percent).repartition(tasks, "bucket")
    met = settled(meet(blocks, salts, percent))
    pairs = compact(met.filter("members is null").select("a", "b").distinct())
    groups = compact(entries_of(groups_of(met)))

    def check(new: DataFrame) -> DataFrame:
        """The pairs that link; only texts that pass the suffix filter are cut into sets again."""
        new = passing(new, ids, "bits", percent)
        nodes = new.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        keys = compact(ids.select("fp", "key").join(nodes, "fp", "left_semi").select("key"))
        near = maybe_in(docs, F.col("key"), membership(keys, "key", keys.count()))
        return passing(new, full_sets(near, n).dropDuplicates(["fp"]), "set", percent)

    links = check(pairs)
    size = F.max("n") - F.floor((percent * F.max("n") + 99) / 100) + 1
    central = compact(groups.groupBy("fp").agg((F.count(F.lit(1)) / size).alias("share")))
    for way in ("central", "all"):
        labels = components(links)
        now = groups.join(labels, F.col("fp") == F.col("node"), "left").select("token", "fp", "n", "pos", F.coalesce("label", "fp").alias("label"))
        split = now.groupBy("token").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("token")
        now = compact(now.join(split, "token", "left_semi"))
        if now.isEmpty():
            break
        if way == "all":
            some = compact(across(in_cells(now, tasks), percent, False))
            new = across(in_cells(now.join(some, "fp", "left_semi"), tasks, ids.select("fp", "data")), percent, True)
        else:
            first = F.struct((-F.col("share")).alias("o"), "fp")
            heads = now.join(central, "fp").groupBy("token", "label").agg(F.min(F.struct(first.alias("o"), "fp", "n", "pos", "label")).alias("h"))
            leads = heads.groupBy("token").agg(F.min("h").alias("h")).select("token", F.col("h.fp").alias("a"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2"))
            met_by = heads.select("token", F.col("h.fp").alias("b"), F.col("h.n").alias("n"), F.col("h.pos").alias("pos"))
            low, high = F.least("n", "n2"), F.greatest("n", "n2")
            most = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
            fits = (100 * low >= percent * high) & (most * (100 + percent) >= percent * (low + high))
            new = leads.join(met_by, "token").filter((F.col("a") != F.col("b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = compact(new.join(pairs, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            pairs = compact(pairs.union(new))
            links = compact(links.union(check(new)))
    labels = components(links)
    named = ids.select("fp", "low").join(labels, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("group"))
    lows = named.groupBy("group").agg(F.min("low").alias("component_id"))
    whole = settled(named.join(lows, "group").select("fp", "group", "component_id"))
    rows = sets.select("doc_id", "key", "fp", F.col("n").cast("bigint").alias("n_shingles")).join(whole, "fp", "left")
    alone = F.col("n_shingles") == 0
    return rows.select("doc_id", "key", "group", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = K.SHINGLE, percent: int = 75) -> DataFrame:
    """The documents, with their columns, of which one of each component stays: the one of smallest doc_id.

    Texts without words link with nothing and all stay.  Only documents that may go are dealt by key; the rest are
    read and passed on where they are.
    """
    names, docs = docs.columns, aside(docs, "doc_id", "text")
    found = settled(similar_documents(docs, n, percent).filter("n_shingles > 0").select("doc_id", "key", "group"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "key")).alias("f")).select("group", F.col("f.key").alias("first"))
    going = settled(found.join(first, "group").filter("key <> first").select(F.col("key").alias("_key")).distinct())
    twice = settled(found.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_key"))
    maybe = settled(going.union(twice).distinct())
    table = membership(maybe, "_key", maybe.count())
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    staying = maybe_in(keyed, F.col("_key"), table, negate=True).drop("_key")
    unsure = maybe_in(keyed, F.col("_key"), table).join(going, "_key", "left_anti")
    if not twice.isEmpty():
        staying = staying.unionByName(unsure.join(twice, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key"))
        unsure = unsure.join(twice, "_key", "left_anti")
    return staying.unionByName(unsure.drop("_key")).toDF(*names)


def oracle_sql(table: str = "documents") -> str:
    """doc_id, n_shingles and component_id for DuckDB, by all pairs that share a shingle; doc_id must be unique."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(g) AS g FROM g),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(c.n, 0)::bigint AS n_shingles, m.component_id FROM w LEFT JOIN c ON w.doc_id = c.doc_id JOIN m ON w.doc_id = m.node"""
