"""The jobs as registered queries: each runs twice into one new folder and returns what the second run leaves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coomat.session import ensure_checkpoints
from jobs import link_ranks, source_profiles

#: Steps of PageRank that SQL repeats; the command line goes on until the change is small.
STEPS = 10


def new_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def job1_link_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new."""
    folder = new_folder(spark, "link-ranks")
    for _ in range(2):
        link_ranks.run(spark, f"{sf_dir}/pages.parquet", f"{folder}/output", f"{folder}/checkpoint", steps=STEPS, tolerance=0.0, digits=10)
    return link_ranks.result(spark, f"{folder}/output")


def job2_source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run writes the same again."""
    folder = new_folder(spark, "source-profiles")
    for _ in range(2):
        source_profiles.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output")
    return source_profiles.result(spark, f"{folder}/output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_link_ranks": job1_link_ranks, "job2_source_profiles": job2_source_profiles}


def _place(rest: str) -> tuple[str, str]:
    bare = f"regexp_extract({rest}, '^[^?#]*')"
    path = f"coalesce(nullif(regexp_extract({bare}, '^[^/]*(/.*)$', 1), ''), '/')"
    return f"translate(regexp_extract({bare}, '^[^/]*'), '{link_ranks.UPPER}', '{link_ranks.LOWER}')", path


def _ranks_sql() -> str:
    host, path = _place("rest")
    whole = "regexp_matches(href, '^(?:[hH][tT][tT][pP][sS]?:)?//')"
    to_host, to_path = _place("regexp_replace(href, '^(?:[hH][tT][tT][pP][sS]?:)?//', '')")
    bare = "regexp_extract(href, '^[^?#]*')"
    here = f"CASE WHEN {bare} = '' THEN path WHEN starts_with({bare}, '/') THEN {bare} ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) || {bare} END"
    other = f"(regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT {whole})"
    href = "'" + link_ranks.HREF.replace("'", "''") + "'"
    out = f"""
WITH own AS MATERIALIZED (SELECT {host} AS host, {path} AS path, coalesce(html, '') AS html FROM (SELECT html, substr(url, strpos(url, '://') + 3) AS rest FROM pages WHERE contains(url, '://'))),
named AS (SELECT * FROM own WHERE host <> ''),
hrefs AS (SELECT host, path, regexp_extract(piece, {href}, 1) AS href FROM (SELECT host, path, unnest(regexp_split_to_array(html, '<[aA]\\s')[2:]) AS piece FROM named)),
found AS (SELECT host, path, CASE WHEN {whole} THEN {to_host} WHEN NOT {other} THEN host END AS to_host, CASE WHEN {whole} THEN {to_path} WHEN NOT {other} THEN {here} END AS to_path FROM hrefs WHERE href <> '' AND NOT starts_with(href, '#')),
G AS MATERIALIZED (SELECT DISTINCT host || path AS src, to_host || to_path AS dst FROM found WHERE to_host <> ''),
N AS MATERIALIZED (SELECT host || path AS node FROM named UNION SELECT dst FROM G),
D AS MATERIALIZED (SELECT src, count(*)::double AS deg FROM G GROUP BY 1),
M AS MATERIALIZED (SELECT G.dst, G.src, 1.0::double / D.deg AS v FROM G JOIN D ON G.src = D.src),
R0 AS MATERIALIZED (SELECT node, 1.0::double / (SELECT count(*) FROM N) AS r FROM N)"""
    for k in range(STEPS):
        out += f""",
R{k + 1} AS MATERIALIZED (SELECT N.node, 0.85::double * coalesce(Y.y, 0.0::double) + (0.85::double * (SELECT coalesce(sum(r), 0.0::double) FROM R{k} WHERE node NOT IN (SELECT src FROM D)) + 0.15::double) / (SELECT count(*) FROM N) AS r
FROM N LEFT JOIN (SELECT M.dst, sum(M.v * R{k}.r) AS y FROM M JOIN R{k} ON M.src = R{k}.node GROUP BY 1) Y ON N.node = Y.dst)"""
    return out + f"""
SELECT regexp_extract(node, '^[^/]*') AS host, substr(node, strpos(node, '/')) AS path, round(r, 10) AS rank, coalesce(o.c, 0)::bigint AS links_out, coalesce(i.c, 0)::bigint AS links_in,
  coalesce(nullif(regexp_extract(regexp_extract(node, '^[^/]*'), '[^.]*$'), ''), '_') AS suffix
FROM R{STEPS} LEFT JOIN (SELECT src, count(*) AS c FROM G GROUP BY 1) o ON node = o.src LEFT JOIN (SELECT dst, count(*) AS c FROM G GROUP BY 1) i ON node = i.dst"""


def _similarity_sql() -> str:
    return f"""
WITH w AS (SELECT coalesce(nullif(lang, ''), '_') AS lang, coalesce(nullif(source, ''), '_') AS source, unnest(regexp_extract_all(translate(text, '{source_profiles.UPPER}', '{source_profiles.LOWER}'), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents),
c AS MATERIALIZED (SELECT lang, source, word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT lang, count(DISTINCT source) AS sources FROM c GROUP BY 1),
d AS (SELECT lang, word, count(*) AS with_word FROM c GROUP BY 1, 2),
x AS MATERIALIZED (SELECT c.lang, c.source, c.word, n * ln(sources::double / with_word::double) AS v FROM c JOIN d ON c.lang = d.lang AND c.word = d.word JOIN s ON c.lang = s.lang WHERE with_word < sources),
z AS (SELECT lang, source, sqrt(sum(v * v)) AS length FROM x GROUP BY 1, 2),
y AS MATERIALIZED (SELECT x.lang, x.source, word, v / length AS v FROM x JOIN z ON x.lang = z.lang AND x.source = z.source)
SELECT a.source, b.source AS other, round(sum(a.v * b.v), 8) AS similarity, a.lang FROM y a JOIN y b ON a.lang = b.lang AND a.word = b.word AND a.source <> b.source GROUP BY a.lang, a.source, b.source"""


def oracle_sql() -> dict[str, str]:
    return {"job1_link_ranks": _ranks_sql(), "job2_source_profiles": _similarity_sql()}
