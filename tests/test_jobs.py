"""The jobs: growing input in two runs, reruns, odd pages and texts, plain versions, and the command lines."""

import collections
import json
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import link_ranks, source_profiles
from tests.conftest import ROOT
from tests.test_entry import rows

DIR = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://A.org/x?q", '<a href="/y">y</a> <A class=k href=\'/y#z\'>again</A> <a href="//b.com">b</a> <a href="mailto:me@x.org">m</a> <a name="n">'),
    (2, "https://b.com", '<p>no links <a href="#top">top</a>'),
    (3, "http://a.org/d/e", '<a href="f">f</a><a href="?k=1">self</a><a href="https://B.com/?z">b</a><a href='),
    (4, None, '<a href="/lost">'),
    (5, "no url", '<a href="/lost">'),
    (6, "http:///none", '<a href="/lost">'),
    (7, "ftp://c", None),
    (8, "http://a.org/x", '<a href="http://c/">c</a>' + "<a href " * 20_000),
]
LINKS = {
    ("a.org/x", "a.org/y"), ("a.org/x", "b.com/"), ("a.org/d/e", "a.org/d/f"), ("a.org/d/e", "a.org/d/e"), ("a.org/d/e", "b.com/"), ("a.org/x", "c/"),
}
SCHEMA = "page_id bigint, url string, html string"


def plain_ranks(links, names, steps, d=0.85):
    out = collections.Counter(a for a, _ in links)
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(steps):
        lost = sum(rank[x] for x in names if not out[x])
        rank = {x: d * sum(rank[a] / out[a] for a, b in links if b == x) + (d * lost + 1 - d) / len(names) for x in names}
    return rank


def read(spark, folder):
    return {r.host + r.path: (r["rank"], r.links_out, r.links_in, r.suffix) for r in link_ranks.result(spark, folder).collect()}


def test_only_new_pages_are_taken_and_ranks_follow(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    pages, out, mark = (str(tmp_path / x) for x in ("pages", "out", "mark"))
    frame = spark.createDataFrame(PAGES, SCHEMA)
    frame.filter("page_id <= 2").coalesce(1).write.parquet(pages)
    how = {"steps": 12, "tolerance": 0.0, "digits": 12}
    link_ranks.run(spark, pages, out, mark, **how)
    assert set(read(spark, out)) == {"a.org/x", "a.org/y", "b.com/"} and "read 2 new pages" in caplog.text
    frame.filter("page_id > 2").coalesce(2).write.mode("append").parquet(pages)
    link_ranks.run(spark, pages, out, mark, **how)
    assert "read 6 new pages" in caplog.text
    got, names = read(spark, out), {x for pair in LINKS for x in pair}
    assert set(got) == names
    for name, rank in plain_ranks(LINKS, names, 12).items():
        assert got[name] == (pytest.approx(rank, abs=2e-12), sum(a == name for a, _ in LINKS), sum(b == name for _, b in LINKS), name.split("/")[0].split(".")[-1])
    caplog.clear()
    link_ranks.run(spark, pages, out, mark, **how)
    assert "read 0 new pages" in caplog.text and read(spark, out) == got
    whole = str(tmp_path / "whole")  # all at once gives the same
    link_ranks.run(spark, pages, whole, str(tmp_path / "mark2"), **how)
    assert read(spark, whole) == got
    frame.filter("page_id = 1").write.mode("append").parquet(pages)  # a page that comes again changes nothing
    link_ranks.run(spark, pages, out, mark, **how)
    assert read(spark, out) == got
    assert sorted(x for x in os.listdir(f"{out}/ranks") if "=" in x) == ["suffix=c", "suffix=com", "suffix=org"]


def test_a_run_that_broke_off_after_the_links_is_mended(spark, tmp_path):
    pages, out, mark = (str(tmp_path / x) for x in ("pages", "out", "mark"))
    spark.createDataFrame(PAGES, SCHEMA).coalesce(1).write.parquet(pages)
    assert link_ranks.take_new(spark, pages, out, mark, 10) == 8  # and no ranks
    link_ranks.run(spark, pages, out, mark, steps=3, tolerance=0.0)
    assert set(read(spark, out)) == {x for pair in LINKS for x in pair}


@pytest.mark.parametrize("pages", [[], [(1, None, "x")], [(1, "http://a/", "no links")]])
def test_few_pages(spark, tmp_path, pages):
    spark.createDataFrame(pages, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "pages"))
    link_ranks.run(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "mark"), steps=3)
    assert read(spark, str(tmp_path / "out")) == ({"a/": (1.0, 0, 0, "a")} if pages and pages[0][1] else {})


DOCS = [(1, "a b b c", "en", "s"), (2, "B a d", "en", "t"), (3, "c\tc d", "en", "u"), (4, None, "en", "v"), (5, "", "en", "w"), (6, "a z", None, ""), (7, "z y", "_", "s"), (8, "a b", "fr", "s"), (9, "a b b c", "en", "s")]


def plain_similarity(docs):
    counts = collections.Counter((lang or "_", source or "_", w) for _, text, lang, source in docs for w in (text or "").lower().split())
    have = collections.Counter((k[0], k[2]) for k in counts)
    sources = {lang: len({k[1] for k in counts if k[0] == lang}) for lang, _, _ in counts}
    v = {k: n * math.log(sources[k[0]] / have[k[0], k[2]]) for k, n in counts.items()}
    length = collections.Counter()
    for (lang, s, _), x in v.items():
        length[lang, s] += x * x
    out = collections.Counter()
    for (lang, s, w), x in v.items():
        for (other, t, u), y in v.items():
            if lang == other and w == u and s != t and x and y:
                out[s, t, lang] += x * y / math.sqrt(length[lang, s] * length[lang, t])
    return out


def test_similarity_equals_a_plain_version_and_reruns(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string").write.parquet(docs)
    for _ in range(2):
        source_profiles.run(spark, docs, out)
        got = {(r.source, r.other, r.lang): r.similarity for r in source_profiles.result(spark, out).collect()}
        assert got == pytest.approx(dict(plain_similarity(DOCS)), abs=1e-7) and len(got) > 4
    assert "read 9 documents" in caplog.text and f"wrote {len(got)} pairs" in caplog.text
    source_profiles.run(spark, docs, out)
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string").write.parquet(empty)
    source_profiles.run(spark, empty, out)
    assert source_profiles.result(spark, out).count() == 0


@pytest.mark.parametrize("name", ["job1_link_ranks", "job2_source_profiles"])
def test_job_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) and rows(got) == rows(want)


def test_command_line(spark, tmp_path):
    spark.createDataFrame(PAGES, SCHEMA).write.parquet(str(tmp_path / "pages"))
    (tmp_path / "c.json").write_text(json.dumps({"steps": 3, "tolerance": 0, "checkpoint": str(tmp_path / "mark"), "pages": "elsewhere"}))
    done = subprocess.run([sys.executable, "-m", "jobs.link_ranks", "--config", str(tmp_path / "c.json"), "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr
    assert "read 8 new pages" in done.stderr and len(read(spark, str(tmp_path / "out"))) == 6


def test_texts_are_not_lower_cased_before_words_are_counted(spark):
    docs = spark.createDataFrame([("en", "a", "The the\tTHE \u00c4b"), (None, "", "x"), ("en", "a", None)], "lang string, source string, text string")
    counts = source_profiles.word_counts(docs)
    steps = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in steps and "translate" not in steps[steps.index("Generate") :]
    assert sorted(map(tuple, counts.collect())) == [("_", "_", "x", 1), ("en", "a", "the", 3), ("en", "a", "\u00c4b", 1)]
