"""Operator 2: language identification by Bayesian evidence fusion.

Evidence on a text's language, all in log space and added up:

* text: multinomial likelihood of hashed byte trigrams, learned from a bounded sample of documents that carry a
  language (``train_docs``), tempered, because neighbouring trigrams are not independent;
* declared: what the markup's ``lang`` says, as a confusion table P(declared | language) from expected counts over all
  rows with a prior that declarations are mostly right;
* suffix: the same for the last label of the host name;
* host: a prior smoothed down a hierarchy, all rows, registered domain, host, each level shrinking to the one above.

Tables come from grouped sums of text posteriors over all rows.  Joins back by host or suffix are on narrow rows
(no text), so a host with a third of all rows is split by Spark's skew join; sums are pre-aggregated.

Defined cases: null or empty text gives no text evidence; a null url or source has the host ""; a missing or odd
declaration is "" and is no evidence; repeated rows count each; of equally likely languages the first by name wins; with no labelled document the
result's language is null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coomat.llm import kernels as K
from coomat.llm.tables import only, settled

GRAM_BITS = 16
#: Trigrams beyond about so many add ever less, because they are not independent.
TEMPER = 200.0
SHRINK = 20.0
TRUST = 50.0


def grams(column: pa.Array):
    """Slice by slice: the first document's index, buckets of byte trigrams, and their bounds by document."""
    data, offs = K.text_bytes(column)
    _, value = K.byte_table()
    code = np.arange(256)
    code[65:91] += 32
    code[:65] = 32  # digits and signs say nothing
    code[91:97] = code[123:128] = 32
    data = code.astype(np.uint8)[data]
    for lo, hi in K.slices(offs):
        part, o = data[offs[lo] : offs[hi]].astype(np.uint32), offs[lo : hi + 1] - offs[lo]
        if len(part) < 3:
            yield lo, np.zeros(0, np.int64), np.zeros(hi - lo + 1, np.int64)
            continue
        h = (part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA6B) + part[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - GRAM_BITS)
        keep = (part[1:-1] != 32) & ~((part[:-2] == 32) & (part[2:] == 32))
        inside = np.ones(len(part) + 1, bool)
        for k in (1, 2):
            at = o[1:] - k
            inside[at[at >= 0]] = False
        at = np.flatnonzero(keep & inside[: len(h)])
        yield lo, h[at].astype(np.int64), np.searchsorted(at, o)


def learn(docs: DataFrame, train_docs: int = 4000) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language) from at most ``train_docs`` different texts, those of smallest hash, each once."""
    known = docs.filter("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"))
    chosen = known.distinct().orderBy("h", "lang").limit(train_docs)
    texts = docs.select(F.col("lang").alias("_l"), F.xxhash64("text").alias("_h"), "text").join(F.broadcast(chosen), (F.col("_l") == F.col("lang")) & (F.col("_h") == F.col("h"))).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for lo, h, at in grams(b.column("text")):
                for i in range(len(at) - 1):
                    own = total.setdefault(langs[lo + i], np.zeros(1 << GRAM_BITS, np.int64))
                    own += np.bincount(h[at[i] : at[i + 1]], minlength=len(own))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])

    def add(key, table):
        out = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([out.tobytes()], pa.binary())})

    rows = texts.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    rows.sort(key=lambda r: r.lang)
    if not rows:
        return [], np.zeros((1 << GRAM_BITS, 0), np.float32)
    counts = np.stack([np.frombuffer(r.counts, np.int64) for r in rows]) + 0.2
    return [r.lang for r in rows], np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)


def host_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and suffix (the last)."""
    parts = F.split(host, "\\.")
    return F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)), F.element_at(parts, -1)


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> id, text, host, declared."""
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    page = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(page, "(?is)<(script|style|title)\\b.*?(?:</\\1\\s*>|\\z)|<[^>]*+(?:>|\\z)|&[#a-z0-9]++;", " ")
    declared = F.lower(F.regexp_extract(F.regexp_extract(page, "(?is)<html[^>]*+", 0), "(?is)\\blang\\s*+=\\s*+[\"']?([a-z]{2,3})\\b", 1))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), host.alias("host"), declared.alias("declared"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...]) -> DataFrame:
    """(keep..., text, host, declared) -> keep, lang, confidence, text_lang.  declared "" is no declaration."""
    langs, table = model
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    if not langs:
        return rows.select(*keep, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    n = len(langs)
    shared = rows.sparkSession.sparkContext.broadcast(table)  # 2**GRAM_BITS rows

    def likelihood(batches):
        for b in batches:
            out = np.zeros((b.num_rows, n))
            for lo, h, at in grams(b.column("text")):
                size = np.diff(at)
                for k in range(n):
                    sums = np.concatenate([[0.0], np.cumsum(shared.value[h, k], dtype=np.float64)])
                    out[lo : lo + len(size), k] = sums[at[1:]] - sums[at[:-1]]
                out[lo : lo + len(size)] *= (TEMPER / (TEMPER + size))[:, None]
            out -= out.max(1, keepdims=True) if n else 0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column("host"), b.column("declared"), flat], [*keep, "host", "declared", "ll"])

    scored = rows.select(*keep, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("declared", F.lit("")).alias("declared"))
    scored = scored.mapInArrow(likelihood, f"{kinds}, host string, declared string, ll array<double>")
    domain, suffix = host_parts(F.col("host"))
    p = [F.exp(F.col("ll")[k]) for k in range(n)]
    total = sum(p[1:], p[0])
    scored = settled(scored.withColumns({"domain": domain, "suffix": suffix} | {f"p{k}": p[k] / total for k in range(n)}))
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in range(n)]
    known = [F.col(f"p{k}") for k in range(n)]
    base = scored.agg(*sums, F.count(F.lit(1)).alias("c")).first()
    prior = [((base[f"s{k}"] or 0.0) + 1) / (base["c"] + n) for k in range(n)]

    def smoothed(level: DataFrame, above: list[Column]) -> list[Column]:
        return [(F.col(f"s{k}") + SHRINK * above[k]) / (F.col("c") + SHRINK) for k in range(n)]

    # down the hierarchy: hosts are few against rows, and every level is a grouped sum
    by_host = scored.groupBy("domain", "host").agg(*sums, F.count(F.lit(1)).alias("c"))
    by_domain = by_host.groupBy("domain").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(n)), F.sum("c").alias("c"))
    by_domain = by_domain.select("domain", *(x.alias(f"d{k}") for k, x in enumerate(smoothed(by_domain, [F.lit(x) for x in prior]))))
    hosts = by_host.join(by_domain, "domain")
    hosts = hosts.select(F.col("host").alias("_host"), *(F.log(x).alias(f"h{k}") for k, x in enumerate(smoothed(hosts, [F.col(f"d{k}") for k in range(n)]))))

    def evidence(column: str, own: str, named: bool) -> DataFrame:
        """log P(value | language) for each value of a column; missing values are no evidence."""
        counts = scored.groupBy(column).agg(*sums)
        right = [F.when(F.col(column) == x, TRUST).otherwise(TRUST / 10 / n) if named else F.lit(TRUST / 10) * x for x in (langs if named else prior)]
        logs = [F.when(F.col(column) == "", 0.0).otherwise(F.log((F.col(f"s{k}") + right[k]) / ((base[f"s{k}"] or 0.0) + 2 * TRUST))) for k in range(n)]
        return counts.select(F.col(column).alias(f"_{column}"), *(x.alias(f"{own}{k}") for k, x in enumerate(logs)))

    joined = scored.join(hosts, F.col("host") == F.col("_host")).join(evidence("declared", "e", True), F.col("declared") == F.col("_declared")).join(evidence("suffix", "x", False), F.col("suffix") == F.col("_suffix"))
    fused = [F.col("ll")[k] + F.col(f"h{k}") + F.col(f"e{k}") + F.col(f"x{k}") for k in range(n)]
    out = joined.select(*keep, *known, *(x.alias(f"f{k}") for k, x in enumerate(fused)))
    top = F.greatest(*(F.col(f"f{k}") for k in range(n))) if n > 1 else F.col("f0")
    best = F.coalesce(*(F.when(F.col(f"f{k}") == top, F.lit(langs[k])) for k in range(n)))
    most = F.greatest(*known) if n > 1 else known[0]
    by_text = F.coalesce(*(F.when(x == most, F.lit(langs[k])) for k, x in enumerate(known)))
    mass = sum((F.exp(F.col(f"f{k}") - top) for k in range(1, n)), F.exp(F.col("f0") - top))
    return out.select(*keep, best.alias("lang"), (1 / mass).alias("confidence"), by_text.alias("text_lang"))


def identify_all(docs: DataFrame, pages: DataFrame, train_docs: int = 4000) -> DataFrame:
    """Every document and every page: doc_id (null for pages), page_id (null for documents), lang, confidence, text_lang."""
    docs, pages = only(docs, "doc_id", "text", "lang", "source"), only(pages, "page_id", "url", "html")
    model = learn(docs, train_docs)
    some = docs.select("doc_id", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "text", F.concat(F.coalesce("source", F.lit("")), F.lit("")).alias("host"), F.lit("").alias("declared"))
    rest = page_rows(pages).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("id").alias("page_id"), "text", "host", "declared")
    return identify(some.unionByName(rest), model, ("doc_id", "page_id"))
