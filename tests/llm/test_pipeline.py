"""The pipeline against brute force, stage by stage, on the smallest tables."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from coomat.llm import packing, weak_rules
from tests.llm.test_operators import SCHEMA, brute_base, brute_components, brute_figures, brute_overlaps, brute_pack, words

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        kept.append((name, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    by = {name: df for name, df in kept}
    assert by["quality_rules"].count() >= by["near_duplicates"].count() >= by["decontamination"].count() == by["personal_data"].count()
    texts = [r.text for r in by["personal_data"].collect()]
    assert not any("@mail" in t for t in texts)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in by["personal_data"].collect()}
    again = {(r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert again == {(r.doc_id, r.piece, r.length) for r in docs.collect()}


@pytest.mark.parametrize("name", ["op1_url_filters", "op5_ngram_jaccard_join", "personal_base_counts", "quality_base", "secret_base_spans"])
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    k = sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[k].astype(object).where(df[k].notna(), None).values.tolist()), key=str)
    assert sorted(got.columns) == k and plain(got) == plain(want)


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 13)) and "pipeline" in names


def brute_votes(text):
    """The rules' votes, by the words of their definitions."""
    n, chars, symbols, dup_lines, repeats = brute_figures(text)
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    per = lambda x, y: x / max(1, y)

    def says(speaks, share, bad, good):
        return 0 if not speaks else -1 if share >= bad else 1 if share <= good else 0

    length = per(chars, n)
    out = {
        "symbols": says(n >= 10, per(symbols, n), 0.15, 0.02),
        "punctuation": says(n >= 10, per(len(re.findall(r"[!-/:-@\[-`{-~]", text)), chars), 0.1, 0.05),
        "repeats": says(n >= 10, per(repeats, n), 0.2, 0.05),
        "vocabulary": -says(n >= 30, len(set(own)) / max(1, n) ** 0.5, 4.0, 2.5),
        "dup_lines": says(len(lines) >= 5, per(dup_lines, len(lines)), 0.3, 0.1),
        "upper": says(n >= 10, per(len(re.findall("[A-Z]", text)), chars), 0.4, 0.15),
        "bangs": says(n >= 10, per(text.count("!"), n), 0.2, 0.05),
        "word_length": 0 if n < 30 else -1 if length < 2 or length > 14 else 1 if 3 < length < 10 else 0,
        "stops": -says(n >= 30, per(text.count("."), n), 0.03, 0.005),
        "longest": says(n >= 10, max(map(len, own), default=0), 200, 60),
    }
    return tuple(out[r] for r in weak_rules.RULES), n < 10 or 100 * repeats > 20 * n


def brute_pipeline(rows, items):
    """(doc_id, text) of the documents that reach the last stage, with their texts there."""
    judged = [(i, t, *brute_votes(t)) for i, t in rows]
    model = weak_rules.fit(sorted(collections.Counter(v for *_, v, _ in judged).items()))
    rows = [(i, t) for i, t, v, failed in judged if not failed and weak_rules.quality(model, v) >= 0.5]
    _, roots = brute_components([t for _, t in rows])
    groups = collections.defaultdict(list)
    for (i, t), root in zip(rows, roots, strict=True):
        groups[root].append((i is None, i, t))
    rows = [min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in groups.values()]
    dirty = {d for d, *_ in brute_overlaps([t for _, t in rows], items)}
    out = []
    for i, t in (r for k, r in enumerate(rows) if k not in dirty):
        clean, end = "", 0
        for kind, s, e in sorted(brute_base(t), key=lambda x: (x[1], -x[2])):
            clean, end = (clean + t[end:s] + f"[{kind.upper()}]" if s >= end else clean), max(end, e)
        out.append((i, clean + t[end:]))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(101)
    prose = lambda n, v=4000: ". ".join(words(rng, 9, v).capitalize() for _ in range(n)) + "."
    texts, items = [prose(rng.randrange(4, 9)) for _ in range(60)], [words(rng, 20, 4000) for _ in range(3)]
    texts += [" ".join(f"{x}###" for x in t.split(" ")) for t in texts[:8]] + [t.upper().replace(" ", "!! ") for t in texts[8:14]] + ["Der " * 90, "a b c", "", None, None]
    texts += texts[20:26] + [t.replace(" w", " changed ", 1) for t in texts[26:30]]
    texts += [f"{prose(3)} {item} {prose(3)}" for item in items] + [f"{prose(4)} ask {k}x@mail.example.org or 10.0.0.{k} now. {prose(2)}" for k in range(5)]
    texts += [prose(2500)]
    ids = [*range(len(texts) - 2), None, len(texts)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    docs.selectExpr("*", "'x' as _key", "1 as fp", "'y' as _figures", "2 as label").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_pipeline(list(zip(ids, texts, strict=True)), items)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = collections.Counter()
    for r in rows:
        size[r.doc_id] += r.length
    assert size == {i: len(t.encode()) + 1 for i, t in want} and None in size and 60 <= len(want) < len(texts) - 25
    lengths = [x for _, t in want for x in [packing.CAPACITIES[-1]] * (len(t.encode()) // packing.CAPACITIES[-1]) + [(len(t.encode()) + 1) % packing.CAPACITIES[-1] or packing.CAPACITIES[-1]]]
    assert sorted(r.length for r in rows) == sorted(lengths)
    for part in {r.bin.rpartition(":")[0] for r in rows}:  # each part is packed as brute force packs its pieces
        own = [r for r in rows if r.bin.rpartition(":")[0] == part]
        assert sorted(c for _, c in {(r.bin, r.capacity) for r in own}) == sorted(c for c, _ in brute_pack([r.length for r in own], packing.CAPACITIES, packing.OPENING))
    assert np.all([r["at"] + r.length <= r.capacity for r in rows])


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
