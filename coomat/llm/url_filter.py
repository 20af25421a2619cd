"""Operator 1: URL filter on a memory-mapped sorted digest array.

Entries are host + path strings with a verdict.  The index file holds the sorted 64-bit xxhash keys, then for each key
the place of its full string.  Executors memory-map the file (Spark distributes it with addFile) and probe it with a
vectorised binary search; a hit counts only if the stored string equals the probed one, so collisions can't decide.

A url is probed under its host and every parent domain.  Hosts are their own entries with the lengths of the paths
listed under them, so only url paths under a listed host are cut, and only to those lengths.

The index must stay under MOST_BYTES; a longer list is split into several index files, which are probed one after the
other, so any size works with bounded memory.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; its verdict is allow.
Repeated urls get equal verdicts; other columns are not read; an empty table gives an empty one; of two entries with
the same string the later wins (in lists; tables have no order, so there the block wins).

Lists of any size come as tables: ``judge_urls(pages, blocklist=spark.read.parquet(path))`` with columns host, path and
verdict; nulls count as "", "" and block.  They are streamed to the index files partition by partition.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coomat.llm.tables import only

MOST_BYTES = 256 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rules as (host, path, verdict).  The longest that fits wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Names of unwanted sites, under each of the suffixes.
UNWANTED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SUFFIXES = ("example.com", "example.net", "example.org")
BLOCKLIST = tuple((f"{name}.{suffix}", "", "block") for name in UNWANTED for suffix in SUFFIXES)


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def write_index(entries: Iterable[tuple[str, str, str]], path: str) -> None:
    """Layout: count; then sorted keys (u64); string ends (u64); then the strings.  A string is kind, key, payload.

    Kinds: r is an entry with its verdict, h a host with the lengths of its paths, m has the length of the longest host.
    """
    strings: dict[str, str] = {}
    lengths: dict[str, set[int]] = {}
    for host, part, verdict in entries:
        strings["r" + host + "\0" + part] = verdict
        lengths.setdefault(host, set()).add(len(part))
    strings |= {"h" + host: ",".join(map(str, sorted(found))) for host, found in lengths.items()}
    strings["m"] = str(max(map(len, lengths), default=0))
    rows = sorted((digest(k), k, v) for k, v in strings.items())
    blobs = [f"{k}\t{v}".encode() for _, k, v in rows]
    with open(path, "wb") as out:
        out.write(np.array([len(rows)], "<u8").tobytes())
        out.write(np.array([r[0] for r in rows], "<u8").tobytes())
        out.write(np.cumsum([len(b) for b in blobs], dtype="<u8").tobytes())
        out.writelines(blobs)


class Index:
    """A memory-mapped index."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<u8", 1)[0])
        self.keys = np.memmap(path, "<u8", "r", 8, (n,)) if n else np.zeros(0, "<u8")
        self.ends = np.memmap(path, "<u8", "r", 8 + 8 * n, (n,)) if n else np.zeros(0, "<u8")
        start = 8 + 16 * n
        self.blob = np.memmap(path, np.uint8, "r", start) if os.path.getsize(path) > start else np.zeros(0, np.uint8)
        self.longest_host = int(self.find(["m"])[0] or 0)

    def find(self, wanted: list[str]) -> list[str | None]:
        """The payload of each string, or None.  All are searched at once; equal keys are told apart by their strings."""
        keys = np.array([digest(w) for w in wanted], "<u8")
        at = np.searchsorted(self.keys, keys)
        out: list[str | None] = [None] * len(wanted)
        inside = at < len(self.keys)
        for i in np.flatnonzero(inside)[self.keys[at[inside]] == keys[inside]]:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                name, _, payload = bytes(self.blob[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])]).decode().rpartition("\t")
                if name == wanted[i]:
                    out[i] = payload
                    break
                k += 1
        return out

    def longest(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each (host, path) the longest entry that fits, as (entry, verdict)."""
        parents = []
        for host, _ in urls:
            own = [host] if 0 < len(host) <= self.longest_host else []  # longer names are in no list
            at = host.find(".", max(0, len(host) - self.longest_host - 1))
            while at >= 0:
                own.append(host[at + 1 :])
                at = host.find(".", at + 1)
            parents.append(own)
        names = list({p for own in parents for p in own})
        listed = {n: [int(x) for x in v.split(",")] for n, v in zip(names, self.find(["h" + n for n in names]), strict=True) if v is not None}
        asked, of = [], []
        for i, own in enumerate(parents):
            path = urls[i][1]
            for p in own:
                for n in listed.get(p, ()):
                    if n <= len(path):
                        asked.append((p, path[:n]))
                        of.append(i)
        best: list[tuple[str, str] | None] = [None] * len(urls)
        for i, (host, part), verdict in zip(of, asked, self.find([f"r{h}\0{p}" for h, p in asked]), strict=True):
            if verdict is not None and (best[i] is None or len(host + part) > len(best[i][0])):
                best[i] = (host + part, verdict)
        return best


def entries_of(entries: Iterable[tuple[str, str, str]] | DataFrame) -> Iterable[tuple[str, str, str]]:
    """Entries of a list, or of a table (host, path, verdict) in a fixed order, one partition at a time."""
    if not isinstance(entries, DataFrame):
        return entries
    rows = only(entries, "host", "path", "verdict").select(F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce("path", F.lit("")), F.coalesce("verdict", F.lit("block")))
    return (tuple(r) for r in rows.toDF("host", "path", "verdict").distinct().orderBy("host", "path", "verdict").toLocalIterator())


def publish(spark: SparkSession, entries: Iterable[tuple[str, str, str]] | DataFrame) -> list[str]:
    """Writes index files of at most about MOST_BYTES and hands them to all executors; their names by SparkFiles.

    Spark serves the files from the driver's folder, which goes when the driver ends.
    """
    names, part, size = [], [], 0

    def flush():
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "index")
        write_index(part, path)
        with open(path, "rb") as f:
            name = f"url-index-{hashlib.sha256(f.read()).hexdigest()[:24]}"
        os.rename(path, os.path.join(folder, name))
        if not any(x.endswith("/" + name) for x in spark.sparkContext.listFiles):
            spark.sparkContext.addFile(os.path.join(folder, name))
        names.append(name)

    for e in entries_of(entries):
        part.append(e)
        size += 64 + 2 * (len(e[0]) + len(e[1]))
        if size > MOST_BYTES:
            flush()
            part, size = [], 0
    if part or not names:
        flush()
    return names


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, blocklist: Iterable[tuple[str, str, str]] | DataFrame = BLOCKLIST, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., url) -> keep, host, path, rule (or null), verdict, listed (the blocklist entry that fits, or null).

    Rules decide first; a url that no rule fits is blocked if the blocklist lists it, and else allowed.
    """
    spark, pages = pages.sparkSession, only(pages, *keep, "url")
    rule_files, block_files = publish(spark, rules), publish(spark, blocklist)

    def run(batches):
        first, second = ([Index(SparkFiles.get(x)) for x in names] for names in (rule_files, block_files))

        def best(indexes, urls):
            found = [x.longest(urls) for x in indexes]
            return [max((y for y in reversed(ys) if y), key=lambda y: len(y[0]), default=None) for ys in zip(*found, strict=True)]  # of equal ones the later file's

        for b in batches:
            urls = [parse(u) for u in b.column("url").to_pylist()]
            ruled, listed = best(first, urls), best(second, urls)
            verdict = [r[1] if r else x[1] if x else "allow" for r, x in zip(ruled, listed, strict=True)]
            columns = [[u[0] for u in urls], [u[1] for u in urls], [r and r[0] for r in ruled], verdict, [x and x[0] for x in listed]]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, pa.string()) for c in columns)], [*keep, "host", "path", "rule", "verdict", "listed"])

    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, "url").mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string, listed string")


def oracle_sql(table: str = "pages") -> str:
    """The same with RULES and BLOCKLIST for DuckDB."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest) + " " + " ".join(f"WHEN {fits(h, p)} THEN 'block'" for h, p, _ in BLOCKLIST) + " ELSE 'allow' END"
    listed = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in BLOCKLIST) + " END"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""
WITH a AS (SELECT page_id, regexp_extract({rest}, '^[^?#]*') AS rest FROM {table}),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(coalesce(rest, ''), '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM a)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, {listed} AS listed FROM b"""
