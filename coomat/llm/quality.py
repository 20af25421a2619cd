"""Operator 4: quality classifier on learned subword embeddings.

A document is the average of learned vectors of its hashed words and character 3- and 4-grams (within words), and
of two marks for repeated and other word windows, with a softmax on top, trained by plain stochastic gradient descent in numpy.  Since average and output layer are linear,
a trained model scores with one number a feature: the difference of the two logits.

Training reads at most ``train_docs`` labelled documents (those of smallest id hash; a documented bound), whole texts.
Scoring reads every whole text once, in bounded slices, and shuffles nothing.

Labels, language, source and id are never inputs of a score.  A document is held out, never learned from, if
crc32(doc_id as text) mod 5 is 0.

Defined cases: a null or empty text scores by the output bias alone; a null doc_id is not held out and has no label;
of repeated labels of one id the lowest counts, null or other values than 0 and 1 are left out; of documents that share an
id the text that sorts first is learned; repeated rows get equal scores; with labels of one class only the score is that class's share, smoothed; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coomat.llm import kernels as K
from coomat.llm.tables import only

BUCKET_BITS = 18
GRAMS = (3, 4)
REPEAT = 3
DIM = 8


def features(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Slice by slice: the first document's index; by kind of feature all buckets, and their bounds by document."""
    sep, value = K.byte_table(lower=False)
    data, offs = K.text_bytes(column)
    shift = K.U(64 - BUCKET_BITS)
    for lo, hi in K.slices(offs):
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, words = K.word_bounds(part, o, sep)
        found = [((K.word_hashes(part, starts, ends, value) + K.U(1)) * K.U(0x9E3779B97F4A7C15) >> shift).astype(np.int32)]
        bounds = [words]
        up, down = K.powers(len(part))
        total = np.zeros(len(part) + 1, K.U)
        np.cumsum(value[part] * up[: len(part)], out=total[1:])
        first = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))  # where characters start
        word = np.zeros(len(part) + 1, np.int32)  # equal at both ends of a gram only within a word
        word[starts] += 1
        word = np.cumsum(word, dtype=np.int32)
        outside = sep[part]
        for n in GRAMS:
            if len(first) <= n:
                found.append(np.zeros(0, np.int32))
                bounds.append(np.zeros(len(o), np.int64))
                continue
            a, z, last = first[:-n], first[n:], first[n - 1 : -1]
            inside = (word[a] == word[last]) & ~outside[a] & ~outside[last]
            a, z = a[inside], z[inside]
            hashes = K.mix((total[z] - total[a]) * down[a] + K.U(n))
            found.append((hashes >> shift).astype(np.int32))
            bounds.append(np.searchsorted(a, o))
        # two more "words": a window of three words that the document has again, and one that it has once
        pairs, at = K.shingle_hashes(K.word_hashes(part, starts, ends, value), words, REPEAT)
        own = K.mix(pairs + np.repeat(np.arange(hi - lo), np.diff(at)).astype(K.U) * K.U(0x9E3779B97F4A7C15))
        by = np.argsort(own)
        same = own[by][1:] == own[by][:-1]
        again = np.zeros(len(own), np.int32)
        again[by] = np.append(same, False) | np.append(False, same)[: len(own)] if len(own) else 0
        found.append(again)
        bounds.append(at)
        yield lo, found, bounds


def by_document(column: pa.Array) -> Iterator[np.ndarray]:
    """All feature buckets of each document."""
    for _, found, bounds in features(column):
        for i in range(len(bounds[0]) - 1):
            yield np.concatenate([f[b[i] : b[i + 1]] for f, b in zip(found, bounds, strict=True)])


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """SGD over (buckets, counts, label): the logit difference of each bucket, and the bias.

    The step of the averaged vectors is scaled by the root of their number, so that long texts learn like short ones.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
    labels = np.array([y for _, _, y in samples])
    bias = np.log([np.sum(labels == 0) + 1.0, np.sum(labels == 1) + 1.0]).astype(np.float32)
    bias -= bias.mean()
    if len(np.unique(labels)) > 1:
        steps = epochs * len(samples)
        done = 0
        for _ in range(epochs):
            for i in rng.permutation(len(samples)):
                ids, counts, label = samples[i]
                lr = rate * (1 - done / steps)
                done += 1
                weight = counts / counts.sum() if len(ids) else counts.astype(np.float32)
                own = vectors[ids]
                hidden = weight @ own
                logits = hidden @ out + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label] -= 1
                back = out @ p
                out -= lr * np.outer(hidden, p)
                bias -= 0.01 * lr * p
                vectors[ids] = own - (lr * len(ids) ** 0.5) * weight[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 3000) -> tuple[np.ndarray, float]:
    """Learns from at most ``train_docs`` labelled documents that are not held out."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label")).filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def cut(batches):
        for b in batches:
            ids, counts = [], []
            for x in by_document(b.column("text")):
                u, c = np.unique(x, return_counts=True)
                ids.append(u.astype(np.int32).tobytes())
                counts.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["label", "ids", "counts"])

    # the chosen side has train_docs rows at most; of repeated documents the first text in order is learned
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(cut, "label int, ids binary, counts binary").collect()
    samples = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.uint32).astype(np.float32), r.label) for r in rows]
    samples.sort(key=lambda s: (s[2], len(s[0]), s[0].tobytes()))
    return train(samples)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table, bias = shared.value
        for b in batches:
            logits = np.full(b.num_rows, bias)
            for lo, found, bounds in features(b.column("text")):
                total, count = 0.0, 0
                for f, at in zip(found, bounds, strict=True):
                    sums = np.concatenate([[0.0], np.cumsum(table[f], dtype=np.float64)])
                    total, count = total + sums[at[1:]] - sums[at[:-1]], count + np.diff(at)
                logits[lo : lo + len(count)] += total / np.maximum(count, 1)
            p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = 3000) -> DataFrame:
    docs = only(docs, "doc_id", "text")
    return score(docs, fit(docs, only(labels, "doc_id", "quality"), train_docs))
