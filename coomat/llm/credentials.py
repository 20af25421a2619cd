"""Operator 11: secret scans that link the parts of a credential.

Some secrets show by themselves (BASE patterns).  Others are weak: a user name, a short password, a random value, a
server's address mean nothing alone.  They are candidates, each of one part: identifier, secret or endpoint.  A text is
cut into scopes (blank lines and section heads like ``[profile]`` part them), and within a scope the parts are
interval-joined: two meet if at most REACH code points lie between them.  A candidate is reported only if its
complement is there:

* a secret, if it meets an identifier; one that is assigned to a name of secrets also if it meets an endpoint;
* an identifier or endpoint, if it meets an ``assign`` of the base or a secret that is reported.

Base spans stand in as parts, too (assign and hex as secrets, access as identifier), and stay whatever they meet.

The join is a sort-merge on positions: the parts of one kind are sorted once, and each interval finds its partners by
binary search, so a text that is nothing but candidates takes n log n and no pairs are made.  Scopes never leave their
document, so nothing is shuffled, and rows can be computed again anywhere.

Defined cases: a null or empty text has no spans; a null doc_id is carried; repeated rows get equal spans; offsets are
in code points, ends exclusive; spans of one kind never overlap, spans of two kinds may; long texts are read whole, in
time about linear; an empty table gives an empty one; other columns are not read (``redact`` carries them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from coomat.llm import pii
from coomat.llm.tables import aside, only

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE_KINDS = 3
ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT = range(6)
#: Code points that may lie between two parts.
REACH = 200

#: Fixed patterns of the base.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

#: Fixed lists: what names of parts look like.
IDENTIFIERS = r"user|user_?name|login|account|account_?id|client_?id|access_?key|access_?key_?id|key_?id|tenant_?id"
SECRETS = r"password|passwd|secret|token|api_?key|pass|pass_?phrase|pwd|secret_?key|secret_?access_?key|private_?key|account_?key|client_?secret|auth|auth_?key|credentials?|signature"
ENDPOINTS = r"host|host_?name|server|endpoint|url|uri|dsn|bucket|region"
_NAMED = re.compile(rf"""(?<![A-Za-z0-9])(?:({IDENTIFIERS})|({SECRETS})|({ENDPOINTS}))["']?+\x20*+[:=]\x20*+["']?+([^\s"'`,;<>(){{}}\[\]|]{{3,}}+)""", re.I | re.A)
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+")
_OTHER_ID = re.compile(r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}+")
_PORT = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}+")
_LINK = re.compile(r"://([^\s\"'`<>|]++)")
_PLACE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|localhost|[a-z]{2}-[a-z]+-[0-9]")
_CUT = re.compile(r"\n(?=[ \t\r]*+\n|\[[^\]\n]{1,80}\][ \t\r]*+(?:\n|\Z))")
#: A text that none of these finds has no secret, so no part of it is reported.
_ANY_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}"
_ANY_SECRET = rf"(?i:{SECRETS})[\"']?\x20*[:=]|[A-Za-z0-9+/_-]{{20}}|://[^\s/]+@"


class Part(NamedTuple):
    start: int
    end: int
    named: bool = False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    out = [(m.start(), m.end(), ASSIGN) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    out += [(m.start(), m.end(), ACCESS) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), HEX) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _classes(value: str) -> int:
    """How many of lower case, upper case, digits and other characters a value has."""
    return any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)


def candidates(text: str, base: list[tuple[int, int, int]]) -> dict[int, list[Part]]:
    """Weak identifiers, secrets and endpoints, those of one kind apart from each other."""
    found: dict[int, list[Part]] = {IDENTIFIER: [], SECRET: [], ENDPOINT: []}
    links = []
    for m in _LINK.finditer(text):  # scheme://user:value@host...
        start, (a, z) = m.start(), m.span(1)
        while start > m.start() - 20 and start and text[start - 1].isalnum():
            start -= 1
        stop = min((k for c in "/?#" if (k := text.find(c, a, z)) >= 0), default=z)
        mark = text.rfind("@", a, stop)
        colon = text.find(":", a, mark) if mark >= 0 else -1
        if a < colon < mark - 1 and mark + 1 < stop:
            found[IDENTIFIER].append(Part(a, colon, True))
            found[SECRET].append(Part(colon + 1, mark, True))
            found[ENDPOINT].append(Part(mark + 1, stop))
        else:
            found[ENDPOINT].append(Part(start, z))
        links.append((0, start, z))
    for m in _NAMED.finditer(text):
        kind = (IDENTIFIER, SECRET, ENDPOINT)[m.lastindex and next(k for k in (1, 2, 3) if m[k] is not None) - 1]
        a, z = m.span(4)
        value = m[4]
        if kind == IDENTIFIER or kind == ENDPOINT and _PLACE.match(value) or kind == SECRET and len(value) >= 6 and _classes(value) >= 2:
            found[kind].append(Part(a, z, True))
    inside = pii.Covered(links)
    emails = pii.emails(text) if "@" in text else []
    found[IDENTIFIER] += [Part(s, e) for s, e in emails if not inside.meets(s, e)]
    found[IDENTIFIER] += [Part(*m.span()) for m in _OTHER_ID.finditer(text)]
    found[ENDPOINT] += [Part(*m.span()) for m in _PORT.finditer(text)]
    found[ENDPOINT] += [Part(*m.span()) for m in pii._IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    taken = pii.Covered([*links, *((0, s, e) for s, e in emails)])
    found[SECRET] += [Part(*m.span()) for m in _VALUE.finditer(text) if _classes(m[0].rstrip("=").replace("/", "a").replace("_", "a").replace("-", "a").replace("+", "a")) >= 3 and len({*m[0]}) >= 12 and not taken.meets(*m.span())]
    strong = pii.Covered([(0, s, e) for s, e, _ in base])
    return {kind: _apart(x for x in parts if not strong.meets(x.start, x.end)) for kind, parts in found.items()}


def _apart(parts) -> list[Part]:
    """By place; of parts that overlap the first stays, of those that start together the longest."""
    out: list[Part] = []
    for x in sorted(parts, key=lambda x: (x.start, -x.end, not x.named)):
        if not out or x.start >= out[-1].end:
            out.append(x)
    return out


class Scopes:
    """The scopes of a text, and the join of intervals within them."""

    def __init__(self, text: str, reach: int = REACH):
        self.cuts = np.array([0, *(m.start() for m in _CUT.finditer(text)), len(text)])
        self.reach = reach

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of what each part reaches: no part crosses the line end where a scope ends."""
        at = np.searchsorted(self.cuts[1:-1], parts[:, 0], "right")
        return np.maximum(parts[:, 0] - self.reach, self.cuts[at]), np.minimum(parts[:, 1] + self.reach, self.cuts[at + 1])

    def meets(self, parts: list[Part], others: list[Part]) -> np.ndarray:
        """For each part whether any of the others (by place) meets it: it starts before the reach ends and ends after it starts."""
        if not parts or not others:
            return np.zeros(len(parts), bool)
        mine, theirs = (np.array([(x.start, x.end) for x in p], np.int64) for p in (parts, others))
        low, high = self.bounds(mine)
        last = np.maximum.accumulate(theirs[:, 1])
        k = np.searchsorted(theirs[:, 0], high, "right")  # others that start in reach or before
        return (k > 0) & (last[k - 1] >= low) & (k > np.searchsorted(theirs[:, 0], self.cuts[np.searchsorted(self.cuts[1:-1], mine[:, 0], "right")]))

    def nearest(self, part: Part, others: list[Part]) -> Part | None:
        """The closest of the others that meet a part; of two as close the first."""
        low, high = (int(x[0]) for x in self.bounds(np.array([(part.start, part.end)])))
        k = bisect_left(others, part.start, key=lambda x: x.start)
        near = [x for x in others[max(0, k - 1) : k + 1] if x.start <= high and x.end >= low]
        return min(near, key=lambda x: (max(x.start - part.end, part.start - x.end), x.start), default=None)


def linked(text: str, base: list[tuple[int, int, int]]) -> dict[int, list[Part]]:
    """The candidates that are reported."""
    found = candidates(text, base)
    if not (found[SECRET] or any(k != ACCESS for _, _, k in base)) or not (found[IDENTIFIER] or found[ENDPOINT] or found[SECRET]):
        return {IDENTIFIER: [], SECRET: [], ENDPOINT: []}
    scopes = Scopes(text)
    strong = {kind: [Part(s, e, True) for s, e, k in base if k == kind] for kind in range(BASE_KINDS)}
    ids = sorted([*found[IDENTIFIER], *strong[ACCESS]])
    met, placed = (scopes.meets(found[SECRET], x) for x in (ids, found[ENDPOINT]))
    secrets = [x for x, a, b in zip(found[SECRET], met, placed, strict=True) if a or b and x.named]
    hashes = [x for x, a in zip(strong[HEX], scopes.meets(strong[HEX], ids), strict=True) if a]
    told = sorted([*strong[ASSIGN], *hashes, *secrets])
    return {SECRET: secrets, **{kind: [x for x, a in zip(found[kind], scopes.meets(found[kind], told), strict=True) if a] for kind in (IDENTIFIER, ENDPOINT)}}


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base and of the reported candidates, by start, then kind."""
    base = base_spans(text)
    return sorted([*base, *((x.start, x.end, kind) for kind, parts in linked(text, base).items() for x in parts)], key=lambda x: (x[0], x[2]))


def scanned(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """The spans of each text; only texts in which a native search sees something are read by patterns."""
    column = pc.fill_null(column, "")
    some = pc.or_(pc.match_substring_regex(column, _ANY_BASE), pc.match_substring_regex(column, _ANY_SECRET)).to_pylist()
    return [spans(column[k].as_py()) if hit else [] for k, hit in enumerate(some)]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_identifier, n_secret, n_endpoint."""
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        name = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)
        for b in batches:
            found = scanned(b.column("text"))
            counts = np.array([np.bincount([k for _, _, k in x], minlength=len(KINDS)) for x in found], np.int64).reshape(-1, len(KINDS))
            n = [pa.array(counts[:, k].copy()) for k in range(len(KINDS))]
            shas = [hashlib.sha256(name([y for y in x if y[2] < BASE_KINDS]).encode()).hexdigest() for x in found]
            columns = [b.column("doc_id"), *n[:BASE_KINDS], pa.array(shas, pa.string()), pa.array(map(name, found), pa.string()), *n[BASE_KINDS:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_identifier", "n_secret", "n_endpoint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_identifier bigint, n_secret bigint, n_endpoint bigint")


def credentials(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> a row for each secret with the identifier and endpoint nearest to it: doc_id, start, end, secret, identifier, endpoint.

    A base secret that meets neither has nulls there.
    """
    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for k, (text, found) in enumerate(zip(b.column("text").to_pylist(), scanned(b.column("text")), strict=True)):
                parts = {kinds: sorted(Part(s, e) for s, e, x in found if x in kinds) for kinds in ((ASSIGN, HEX, SECRET), (ACCESS, IDENTIFIER), (ENDPOINT,))}
                scopes = Scopes(text or "")
                for x in _apart(parts[ASSIGN, HEX, SECRET]):
                    near = [scopes.nearest(x, parts[o]) for o in ((ACCESS, IDENTIFIER), (ENDPOINT,))]
                    at.append(k)
                    rows.append((x.start, x.end, text[x.start : x.end], *(y and text[y.start : y.end] for y in near)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "start", "end", "secret", "identifier", "endpoint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, secret string, identifier string, endpoint string")


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with spans replaced by their kind; where spans overlap, the first and longest covers the rest."""
    out, end = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out += [text[end:s], f"[{KINDS[kind].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all reported spans replaced in ``text``; other columns stay as they are."""
    names, docs = docs.columns, aside(docs, "text")

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [t if not x else redacted(t, x) for t, x in zip(b.column(at).to_pylist(), scanned(b.column(at)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def base_sql(table: str = "documents") -> str:
    """Counts and digest of the base spans for DuckDB: a match starts after the pieces and matches before it."""
    patterns = {
        "assign": "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
    }
    long = {"assign": "length(regexp_replace(m, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?', '')) >= 8", "access": "length(m) >= 16", "hex": "length(m) >= 32"}
    one = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, '{name}' AS name, a, a + length(m) AS z FROM (SELECT rid, m, length(array_to_string(pieces[1:n], '')) + length(array_to_string(ms[1:n - 1], '')) AS a "
        f"FROM (SELECT rid, ms, pieces, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS n FROM (SELECT rid, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS pieces FROM docs))) WHERE {long[name]}"
        for k, (name, p) in enumerate(patterns.items())
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
spans AS ({one}),
told AS (SELECT rid, string_agg(name || ':' || a::bigint || ':' || z::bigint, ',' ORDER BY a, kind) AS s, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2 FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::bigint AS n_assign, coalesce(n1, 0)::bigint AS n_access, coalesce(n2, 0)::bigint AS n_hex, sha256(coalesce(s, '')) AS base_sha256
FROM docs LEFT JOIN told USING (rid)"""
